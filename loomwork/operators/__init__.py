"""loomwork.operators"""
