"""loomwork.plans"""
