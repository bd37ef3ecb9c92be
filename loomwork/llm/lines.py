"""Line dedup by a segment-partition edit join, with DataFrame operations only.

Distinct lines are cut into ``edits + 1`` segments. Two lines within ``edits`` edits
share a segment, at a place that lengths bound: each line indexes its own
segments under its length and probes those substrings of its own that could be a
segment of an equally long or shorter line. Keys that only one line has fall out by
aggregation. Keys of more than ``HOT`` lines are refined: what is left of their lines
before and behind the shared segment has so many edits each that both sides are cut into
segments again, of which near lines share one a side; then what is left beside these. In keys of up to ``HOT`` lines, those that have no line of near counts of
letters beside them fall out. Links are found in steps, so that large groups of
variants take linear work: each line, a few times, against the one hub (a line drawn
from each key) that it shares most keys with; then, in keys that still hold more than
one component, lines of different components. Candidates whose counts of letters are
near are verified by Spark's banded edit distance with a threshold.

Lines of a component are one line; its first occurrence (least key, then place)
stays, the others are removed. Lines under ``min_chars`` characters have no edit
join: they are left alone or, with ``short``, removed where an equal one comes
earlier, if they hold a word. Equal lines are told by 128 bits of hash.

Defined results: a null or empty text is one empty line and stays as it is (null
stays null); null keys come first; a row that repeats whole loses its lines as any
later document does; of equal keys the text decides, then the row; an empty table
gives an empty result; ``deduplicated`` passes other columns on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import merged, ranked
from .mixing import WORD
from .scratch import Scratch

EDITS = 2
MIN_CHARS = 20
# The letters that are counted to tell lines apart.
LETTERS = "etainrsoldcumpgh"
#: Steps in which each line meets one hub before the lines of a key meet each other.
ROUNDS = 2
#: Lines of a key from which it is refined, and how often at most (what is left then still meets).
HOT, FINER = 64, 2


def _place(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th (from 1) of ``parts`` even segments, the longer ones last."""
    base, short = F.floor(length / parts).cast("int"), parts - length % parts
    return ((i - 1) * base + F.greatest(F.lit(i - 1) - short, F.lit(0)) + 1).cast("int"), base + F.when(short < i, 1).otherwise(0)


def _segments(length: Column, edits: int) -> list[tuple[int, int, Column, Column, bool]]:
    """(shift, segment, start, size, indexed) of what a line is found by: its own segments first, then its probes."""
    own, probes = [], []
    parts = edits + 1
    for shift in range(edits + 1):  # how much shorter the indexed line is
        for i in range(1, parts + 1):
            start, size = _place(length - shift, i, parts)
            low, high = max(-(i - 1), shift - (parts - i)), min(i - 1, shift + (parts - i))
            for move in range(low, high + 1):
                (probes if shift or move else own).append((shift, i, start + move, size, not shift and not move))
    return own + probes


def segment_keys(line: Column, length: Column, edits: int) -> Column:
    """Hashes of a line's segments, then of the substrings it probes with (null where they don't fit)."""
    keys = []
    for shift, i, at, size, indexed in _segments(length, edits):
        k = F.xxhash64(length - shift, F.lit(i), F.substring(line, at, size))
        keys.append(k if indexed else F.when((at >= 1) & (at + size - 1 <= length), k))
    return F.array(*keys)


def _beside(line: Column, length: Column, pos: Column, edits: int) -> Column:
    """A line without the segment of its key at ``pos`` of ``segment_keys``."""
    places = F.array(*(F.struct(at.alias("at"), size.alias("size")) for _, _, at, size, _ in _segments(length, edits)))
    at, size = F.get(places, pos)["at"], F.get(places, pos)["size"]
    return F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + size, length))


def _side(part: Column, shift: Column, edits: int, own: Column) -> list[tuple[int, Column, Column, Column, Column]]:
    """(segment, fit, segment's text, text beside it, indexed) of what one side of a shared segment is found by, when it may have ``edits`` edits.

    ``shift``: how much longer it is than the side of the indexed line; ``own``: it is that of an indexed line.
    """
    length, parts, found = F.char_length(part), edits + 1, []
    for j in range(1, parts + 1):
        start, size = _place(length - shift, j, parts)
        for move in range(-(j - 1), j):
            at = start + move
            fit = F.abs(shift - move) <= parts - j
            beside = F.concat(F.substring(part, F.lit(1), at - 1), F.substring(part, at + size, length))
            found.append((j, fit & (length >= shift) & (at >= 1) & (at + size - 1 <= length), F.substring(part, at, size), beside, own & F.lit(not move)))
    return found


def _sides(line: Column, length: Column, pos: Column, edits: int) -> list[Column]:
    """What is before and behind the segment of a line's key at ``pos`` of ``segment_keys``, which segment it is, and how much longer than in an indexed line each side is."""
    parts, spots = edits + 1, []
    for shift, i, at, size, own in _segments(length, edits):
        start = _place(length - shift, i, parts)[0]
        spots.append(F.struct(at.alias("at"), size.alias("size"), F.lit(i).alias("i"), (at - start).cast("int").alias("move"), F.lit(shift).alias("shift")))
    spot = F.get(F.array(*spots), pos)
    before, behind = F.substring(line, F.lit(1), spot["at"] - 1), F.substring(line, spot["at"] + spot["size"], length)
    return [before.alias("before"), behind.alias("behind"), spot["i"].alias("i"), spot["move"].alias("move"), (spot["shift"] - spot["move"]).alias("other")]


def _refined(sides: DataFrame, edits: int) -> DataFrame:
    """(id, found: k, line, indexed): by which lines are found among those of their key, and what is left of them beside the shared parts.

    ``sides``: (id, k, own, before, behind, i, move, other). Of near lines one shared segment, the
    i-th, has ``i - 1`` edits before it and ``edits - i + 1`` behind it at most, so both sides
    share a segment of their own there.
    """
    found = None
    for i in range(1, edits + 2):
        some = []
        for j, fit, text, rest, indexed in _side(F.col("before"), F.col("move"), i - 1, F.col("own")):
            for h, fits, other, left, too in _side(F.col("behind"), F.col("other"), edits - i + 1, F.col("own")):
                key = F.xxhash64("k", F.lit(j), text, F.lit(h), other)
                some.append(F.struct(F.when(fit & fits, key).alias("k"), F.concat(rest, left).alias("line"), (indexed & too).alias("indexed")))
        one = sides.where(F.col("i") == i).select("id", F.array(*some).alias("found"))
        found = one if found is None else found.union(one)
    return found


def letters(line: Column) -> Column:
    """How often a line has each of sixteen letters, modulo 16, packed into a long."""
    counts = [(F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit("")))) % 16 for c in LETTERS]
    packed = F.lit(0).cast("long")
    for i, n in enumerate(counts):
        packed = packed.bitwiseOR(F.shiftleft(n.cast("long"), 4 * i))
    return packed


def _may_be_near(x: str, y: str, edits: int) -> Column:
    """An edit changes two of the counts by one at most."""
    apart = F.lit(0)
    for i in range(len(LETTERS)):
        d = F.abs(F.shiftrightunsigned(x, 4 * i).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(y, 4 * i).bitwiseAND(F.lit(15)))
        apart = apart + F.least(d, 16 - d)
    return apart <= 2 * edits


def _verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    one, two = lines.select(F.col("id").alias("a"), F.col("line").alias("x")), lines.select(F.col("id").alias("b"), F.col("line").alias("y"))
    near = F.levenshtein("x", "y", edits).between(0, edits)
    return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")


def _possible(members: DataFrame, edits: int, hot: int) -> DataFrame:
    """Members whose key has another line of near counts of letters, one of the two indexed; of keys of over ``hot`` lines, all.

    ``members``: (k, many, id, indexed, letters). No member meets more than ``hot`` others here.
    """
    few = members.where(F.col("many") <= hot)
    other = few.select(F.col("k").alias("key"), F.col("id").alias("beside"), F.col("indexed").alias("own"), F.col("letters").alias("theirs"))
    may_link = (F.col("k") == F.col("key")) & (F.col("id") != F.col("beside")) & (F.col("indexed") | F.col("own")) & _may_be_near("letters", "theirs", edits)
    return few.join(other, may_link, "left_semi").union(members.where(F.col("many") > hot))


def _open(members: DataFrame, part: DataFrame | None, step: int, scratch: Scratch, before: str | None) -> DataFrame:
    """Members of the keys whose lines are in more than one component, each with the key's weight and hub; saved, and ``before`` dropped.

    ``members``: (k, weight, id, indexed, letters); keys of the same lines become one of their
    summed weight. The hub is the indexed line of the least hash, another one at each step.
    """
    members = members.select("k", "weight", "id", "indexed", "letters")
    if part is None:
        labelled = members.withColumn("component", F.col("id"))
    else:  # read twice, so labels are written, and joined once
        labelled = members.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
        labelled = scratch.save(labelled, f"labels-{step}")
        scratch.drop(*[before] if before else [])
    drawn = F.when(F.col("indexed"), F.xxhash64("id", F.lit(step)))
    hub = [F.min_by(c, drawn).alias(n) for c, n in (("id", "hub"), ("component", "theirs"), ("letters", "other"))]
    who = [F.bit_xor(F.xxhash64("id", "indexed", F.lit(i))).alias(f"who{i}") for i in (0, 1)]
    mixed = labelled.groupBy("k").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), *who, F.count("*").alias("many"), F.first("weight").alias("weight"), *hub)
    same = ["who0", "who1", "many"]
    mixed = mixed.where("c0 <> c1").groupBy(*same).agg(F.min("k").alias("k"), F.sum("weight").alias("weight"), *(F.min(c).alias(c) for c in ("hub", "theirs", "other")))
    found = scratch.save(labelled.drop("weight").join(mixed.drop(*same), "k"), f"open-{step}")
    scratch.drop(f"labels-{step}")
    return found


def _voted(members: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b): each line with the hub of another component that it shares most keys with."""
    votes = members.where((F.col("component") != F.col("theirs")) & _may_be_near("letters", "other", edits)).groupBy("id", "hub").agg(F.sum("weight").alias("votes"))
    best = votes.groupBy("id").agg(F.max_by("hub", ranked("votes", "hub")).alias("hub"))
    return best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _met(members: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of lines of one key and different components."""
    here = members.where("indexed").select("k", F.col("id").alias("i"), F.col("component").alias("ci"), F.col("letters").alias("li"))
    there = members.select("k", F.col("id").alias("p"), F.col("component").alias("cp"), F.col("letters").alias("lp"))
    met = here.join(there, (here["k"] == there["k"]) & (F.col("ci") != F.col("cp")) & _may_be_near("li", "lp", edits))
    return met.select(F.least("i", "p").alias("a"), F.greatest("i", "p").alias("b")).distinct()


def _shared(keys: DataFrame, edits: int) -> DataFrame:
    """The keys (k, many) of ``keys`` (id, pos, k) that two lines or more have, one of them as its own segment."""
    buckets = keys.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("pos").alias("own"), F.count("*").alias("many"))
    return buckets.where(f"lo <> hi and own <= {edits}").select("k", "many")


def line_links(lines: DataFrame, scratch: Scratch, edits: int = EDITS, hot: int = HOT) -> DataFrame:
    """(id, component) of the distinct ``lines`` (id, line, length, keys) that are near others."""
    keys = lines.select("id", F.posexplode("keys").alias("pos", "k")).where("k is not null")
    shared = scratch.save(_shared(keys, edits), "buckets")
    members = scratch.save(keys.join(shared.hint("shuffle_hash"), "k").select("k", "many", "id", "pos"), "shared-0")
    near = lines.select("id", "line", "length").join(members.select("id").distinct().hint("merge"), "id")
    near = scratch.save(near.withColumn("letters", letters(F.col("line"))), "near")
    ready, before = [], "shared-0"
    for level in range(1, FINER + 1):
        over = members.where(F.col("many") > hot)
        if over.isEmpty():
            break
        ready.append(members.where(F.col("many") <= hot))
        if level == 1:
            texts = over.join(near.drop("letters"), "id")
            sides = texts.select("id", "k", (F.col("pos") <= edits).alias("own"), *_sides(F.col("line"), F.col("length"), F.col("pos"), edits))
            rest = scratch.save(_refined(scratch.save(sides, "sides"), edits), "rest-1")
            finer = rest.select("id", F.explode("found").alias("one")).select("id", "one.k", "one.line", F.when(F.col("one.indexed"), 0).otherwise(edits + 1).alias("pos"))
            finer = finer.where("k is not null").withColumn("length", F.char_length("line"))
        else:
            rest = over.select("id", "k", "line" if level == 2 else _beside(F.col("line"), F.col("length"), F.col("pos"), edits).alias("line"))
            rest = scratch.save(rest.withColumn("length", F.char_length("line")).withColumn("keys", segment_keys(F.col("line"), F.col("length"), edits)), f"rest-{level}")
            finer = rest.select("id", "line", "length", F.col("k").alias("outer"), F.posexplode("keys").alias("pos", "k")).where("k is not null")
            finer = finer.withColumn("k", F.xxhash64("outer", "k"))
        members = scratch.save(finer.join(_shared(finer, edits).hint("shuffle_hash"), "k").select("k", "many", "id", "pos", "line", "length"), f"shared-{level}")
    ready.append(members)
    members = ready[0].select("k", "many", "id", "pos")
    for more in ready[1:]:
        members = members.union(more.select("k", "many", "id", "pos"))
    members = members.select("k", "many", "id", (F.col("pos") <= edits).alias("indexed")).distinct().join(near.select("id", "letters"), "id")
    members = scratch.save(_possible(scratch.save(members, "members"), edits, hot), "possible").withColumn("weight", F.lit(1).cast("long"))
    part, before = None, None
    for step in range(ROUNDS + 1):
        members = _open(members, part, step, scratch, before)
        before = f"open-{step}"
        pairs = _voted(members, edits) if step < ROUNDS else _met(members, edits)
        found = scratch.save(_verified(pairs, near, edits), f"links-{step}")
        part = merged(part, found, scratch, f"part-{step}")
    scratch.drop("buckets", "members", "possible", "sides", before, "near", *(f"{n}-{k}" for k in range(FINER + 1) for n in ("shared", "rest")))
    return part


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _compared(line: Column, min_chars: int, short: bool) -> Column:
    """Whether a line goes where it comes again."""
    return (F.char_length(line) >= min_chars) | (F.lit(short) & line.rlike(WORD))


def _told(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def removed(docs: DataFrame, text: str = "text", key: str = "doc_id", edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False, hot: int = HOT) -> DataFrame:
    """(key, told, gone) of each distinct row (``told``: a hash of its text) that loses lines: their places."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("told"), F.posexplode(_split(F.col(text))).alias("pos", "line"))
    one, two = _told(F.col("line"))
    places = scratch.save(rows.where(_compared(F.col("line"), min_chars, short)).select("key", "told", "pos", one.alias("one"), two.alias("two")), "places")
    lines = rows.where(F.char_length("line") >= min_chars).select("line").distinct().withColumn("length", F.char_length("line"))
    lines = lines.select(F.monotonically_increasing_id().alias("id"), "line", "length", segment_keys(F.col("line"), F.col("length"), edits).alias("keys"))
    lines = scratch.save(lines, "distinct")  # keys are written, as codegen makes slow work of expressions below an explode
    linked = line_links(lines, scratch, edits, hot).withColumnRenamed("id", "line_id")
    linked = lines.select("id", "line").join(linked.hint("merge"), F.col("id") == F.col("line_id")).select(one.alias("one"), two.alias("two"), "component")
    again = places.groupBy("one", "two").agg(F.count("*").alias("many")).where("many > 1").select("one", "two", F.lit(None).cast("long").alias("component"))
    wanted = linked.union(again).groupBy("one", "two").agg(F.max("component").alias("component"))
    met = places.join(wanted.hint("shuffle_hash"), ["one", "two"])
    # lines that are near others have their component as class, others their own hash
    met = scratch.save(met.select("key", "told", "pos", F.coalesce("component", "one").alias("class"), F.when(F.col("component").isNull(), F.col("two")).alias("more")).distinct(), "met")
    scratch.drop("distinct", "places")
    firsts = met.groupBy("class", "more").agg(F.min(F.struct("key", "told", "pos")).alias("first")).withColumnsRenamed({"class": "c", "more": "m"})
    gone = met.join(firsts, (F.col("class") == F.col("c")) & F.col("more").eqNullSafe(F.col("m"))).where(~F.struct("key", "told", "pos").eqNullSafe(F.col("first")))
    gone = scratch.save(gone.groupBy("key", "told").agg(F.collect_list("pos").alias("gone")), "gone")
    scratch.drop("met")
    return gone


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False, hot: int = HOT, counts: tuple[str, str] = ("__lines", "__removed")) -> DataFrame:
    """``docs`` without the removed lines, and with two columns named ``counts``: of lines, and of removed ones."""
    gone = removed(docs, text, key, edits, min_chars, short, hot)
    # the document's columns travel in a struct, so that none can clash with ours
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("told"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    repeated = rows.groupBy("key", "told").agg(F.count("*").alias("many")).where("many > 1")
    if repeated.isEmpty():
        rows = rows.withColumn("copy", F.lit(1))
    else:
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key", "told").orderBy("told")))
    rows = rows.alias("d").join(gone.alias("g"), F.col("d.key").eqNullSafe(F.col("g.key")) & (F.col("d.told") == F.col("g.told")), "left").select("row", "copy", "gone")
    rows = rows.withColumn("split", _split(F.col("row")[text]))
    n = F.size("split")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.when(F.col("copy") > 1, F.filter("split", lambda x: ~_compared(x, min_chars, short))).when(F.col("gone").isNull(), F.col("split")).otherwise(F.transform(left, lambda i: F.get("split", i)))
    rows = rows.withColumn("kept", kept)
    lost = n - F.size("kept")
    new = F.when(lost == 0, F.col("row")[text]).otherwise(F.array_join("kept", "\n"))
    return rows.select(*((new if c == text else F.col("row")[c]).alias(c) for c in docs.columns), n.cast("long").alias(counts[0]), lost.cast("long").alias(counts[1]))


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(key, n_lines, n_removed, kept_sha256) of each document."""
    done = deduplicated(docs.select(key, text), text, key, **options)
    return done.select(key, F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256"))
