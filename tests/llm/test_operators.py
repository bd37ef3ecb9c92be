import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import jaccard, lines, media, mixing, packing, passages, quality, queries, repetition, secrets, suffix

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, id string, piece string, line string, n int, m int"


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = prose(70)
    texts = [prose(int(rng.integers(60, 120))) for _ in range(12)]
    texts += [texts[0], texts[0], texts[1] + " tail", prose(40) + " " + shared + " " + prose(40), prose(30) + " " + shared + " " + prose(50)]
    near = texts[2].split()
    texts += [" ".join(near[:20] + ["changed"] + near[21:]), " ".join(near[:-3])]
    texts += ["line one of the boilerplate text\n" + prose(20), "line one of the boilerplate tex\n" + prose(20), "line two of the boilerplate text\n" + prose(20), "a\nb\n" + "wholly another line of this text"]
    texts += [None, "", "one", "one", "two words", "\n\n", "é" * 300, "word " * 500, "ab" * 400, shared[:150] + "ß" + shared[:150]]
    return [(i, t, "en", [None, "s0", "s1", "é"][i % 4 if i > 5 else 1], len(t or ""), 1, "x", "y", "z", 0, 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_packing(docs, rows, empty):
    got = packing.pack(docs, capacity=32).collect()
    encode = packing.Encoder(packing.default_tokenizer())
    size = {r[0]: len(encode(r[1] or "")) // 4 + 1 for r in rows}
    assert Counter(r.doc_id for r in got) == {k: -(-n // 32) for k, n in size.items()}
    bins = defaultdict(list)
    for r in got:
        assert r.start == 32 * r.piece and r.length == min(32, size[r.doc_id] - r.start)
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))] and sum(n for _, n in items) <= 32
    assert len(bins) <= 1.05 * sum(size.values()) / 32 + 2
    assert packing.pack(empty).count() == 0
    twice = packing.pack(docs.where("doc_id < 3").union(docs.where("doc_id < 3")), capacity=32)
    assert twice.count() == 2 * sum(-(-size[k] // 32) for k in range(3)) == twice.select("sequence_id", "offset").distinct().count()


def test_repetition_and_media(docs, rows, empty):
    got = by_id(repetition.repetition(docs))
    assert len(got) == len(rows) and not got[23].kept and all(got[i].kept for i in range(12))
    assert not by_id(repetition.repetition(docs))[next(r[0] for r in rows if r[1] == "word " * 500)].kept
    stored = by_id(media.stored(docs))
    for i, text, *_ in rows:
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert stored[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and stored[i].n_bytes == len(data)
        assert stored[i].media_sha256 == hashlib.sha256(stored[i].media).hexdigest()
    assert repetition.repetition(empty).count() == media.stored(empty).count() == 0


def test_secrets(spark, docs, empty):
    texts = [(1, 'x token = "abcdefgh1234" y'), (2, None), (3, "ghp_" + "aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5"), (4, "plain words only")]
    got = by_id(secrets.digest(secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"))))
    assert got[1].n_assign == 1 and got[1].spans == "assign:2:23" and got[1].base_sha256 == hashlib.sha256(b"assign:2:23").hexdigest()
    assert got[2].spans == got[4].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans.startswith("grammar:0:") and got[3].n_assign == 0
    assert secrets.digest(secrets.scan(empty)).count() == 0


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    data = [(i, (" " if i % 3 else "### ").join(rng.choice(words, 60))) for i in range(400)]
    texts, labels = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(9999, 1), (5, None)], "doc_id long, quality int")
    got = by_id(quality.classify(texts, labels))
    held = [r for r in got.values() if r.held_out]
    assert len(got) == 400 and held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    none = quality.classify(docs, labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5} and quality.classify(empty, labels).count() == 0


def test_mixing(docs, rows, empty):
    got = by_id(mixing.mix(docs))
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total, names = Counter(), sorted({s for s in source.values() if s is not None}) + [None]
    for k, n in sizes.items():
        total[source[k]] += n
        assert got[k]["size"] == n and got[k].taken <= 2 * n
    weight, left, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    while True:  # excess is dealt again until no source is above
        share = left / sum(w for s, w in weight.items() if s not in target)
        over = [s for s in names if s not in target and share * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
    target |= {s: share * w for s, w in weight.items() if s not in target}
    for s in names:
        own = [k for k in sizes if source[k] == s]
        assert got[own[0]].target == pytest.approx(target[s]) and got[own[0]].source_size == total[s]
        assert sum(got[k].taken for k in own) == pytest.approx(target[s], rel=0.05)
    assert by_id(mixing.mix(docs)) == got and mixing.mix(empty).count() == 0
    mixed = mixing.mixed(docs)
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert mixed.columns == docs.columns and all(words[k] == got[k].taken for k in sizes)


def test_small_sources_of_a_large_mix_meet_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)  # several shards
    sizes = [100, 150, 400, 513, 700, 1026, 5000, 0, 1] + [40_000, 90_000]
    rows = [(100 * s + d, f"s{s:02d}", " ".join(["w"] * (n // 4 + (n % 4 if d == 0 else 0)))) for s, n in enumerate(sizes) for d in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for share in (1.5, 0.4):
        got = mixing.mix(docs, block=512, share=share).groupBy((F.col("doc_id") / 100).cast("int").alias("s")).agg(F.first("source_size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
        assert {r.s: r.size for r in got} == dict(enumerate(sizes))
        for r in got:
            assert r.taken <= 2 * r.size and abs(r.taken - r.target) <= max(1, 0.05 * r.target), r


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def brute_removed(rows, width=100):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        cut = np.zeros(len(data), bool)
        for j in range(len(data) - width + 1):
            if data[j : j + width] in seen:
                cut[j : j + width] = True
            seen.add(data[j : j + width])
        out[i] = (int(cut.sum()), int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()), hashlib.sha256(bytes(b for b, c in zip(data, cut, strict=True) if not c)).hexdigest())
    return out


def test_suffix(docs, rows, empty):
    got = by_id(suffix.digest(docs))
    assert {k: (r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == brute_removed(rows)
    assert suffix.digest(empty).count() == 0


def test_jaccard(docs, rows, empty):
    got, sets = by_id(jaccard.join(docs)), {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    group = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(s), group[k]) for k, s in sets.items()}
    assert jaccard.join(empty).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        old, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
    return row[-1]


def test_lines(docs, rows, empty):
    got, first = by_id(lines.digest(docs)), {}
    for i, text, *_ in rows:
        for j, line in enumerate((text or "").split("\n")):
            if len(line) >= 20:
                first.setdefault(line, (i, j))
    group = {x: x for x in first}
    names = list(first)
    for _ in range(3):
        for a in names:
            for b in names:
                if abs(len(a) - len(b)) <= 2 and len(a) < 300 and edits(a, b) <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for x, at in first.items():
        least[group[x]] = min(least.get(group[x], at), at)
    for i, text, *_ in rows:
        split = (text or "").split("\n")
        kept = [x for j, x in enumerate(split) if len(x) < 20 or least[group[x]] == (i, j)]
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_sha256) == (len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()), i
    assert lines.digest(empty).count() == 0 and lines.deduplicated(docs).columns[: len(docs.columns)] == docs.columns


def test_short_lines_that_come_again(spark):
    body = "a line of more than twenty letters"
    texts = ["Les.\nof\n\n" + body, "of\n\nLess.\nLes.", "Les.\nLes.\nnew", "Les.\nLes.\nnew", " \n!", None]
    docs = spark.createDataFrame([(min(i, 2) if i < 4 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text or "", r["__removed"]) for r in lines.deduplicated(docs, short=True).collect())
    assert got == [(0, texts[0], 0), (1, "\nLess.", 2), (2, "", 3), (2, "new", 2), (4, " \n!", 0), (5, "", 0)]


def test_registered_lines_go_at_every_length(spark, tmp_path):
    docs = spark.createDataFrame([(0, "Les.\nfirst", 0), (1, "Les.\nsecond", 0)], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.op7_lines(spark, str(tmp_path)).collect()} == {0: 0, 1: 1}


def test_passages(docs, rows, empty):
    got = passages.passages(docs).collect()
    pairs = {(r.doc_id, r.match_doc_id) for r in got}
    assert {(12, 0), (13, 0), (14, 1), (16, 15), (17, 2), (18, 2)} <= pairs
    assert not {r.doc_id for r in got} & set(range(12))
    words = {r[0]: WORD.findall((r[1] or "").lower()) for r in rows}
    found = next(r for r in got if r.doc_id == 16)
    assert words[16][found.start_word : found.end_word] == words[15][found.match_start : found.match_end] and found.end_word - found.start_word >= 70
    assert passages.passages(empty).count() == 0


def test_passages_around_an_unrelated_body(spark):
    rng = np.random.default_rng(21)
    word = lambda: f"w{rng.integers(10**9)}"
    head, tail = ([word() for _ in range(60)] for _ in range(2))
    docs = spark.createDataFrame([(i, " ".join(head + [word() for _ in range(150)] + tail)) for i in range(3)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word, r.match_doc_id) for r in passages.passages(docs).collect())
    assert got == [(i, s, s + 60, 0) for i in (1, 2) for s in (0, 210)]


@pytest.mark.parametrize("name", ["op1_packing", "op2_quality", "op4_secrets", "op5_mixing", "op9_repetition", "op10_media"])
def test_queries_run_over_all_documents(spark, name):
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES[name](spark, sf).select("doc_id").distinct().count() == 200


def test_pipeline_near_copies_with_null_keys(spark):
    import corpus_pipeline

    rng = np.random.default_rng(31)
    one, two, three, four = (" ".join(f"w{w}" for w in rng.integers(0, 10**6, 40)) for _ in range(4))
    rows = [(5, one), (-3, one), (7, two), (None, two), (None, three), (None, three), (None, four), (None, four + " more"), (None, None), (None, "short"), (9, "short")]
    got = corpus_pipeline.jaccard_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter((r.doc_id, (r.text or "").removesuffix(" more")) for r in got) == Counter([(-3, one), (7, two), (None, three), (None, four), (None, ""), (9, "short")])


def test_pipeline(spark):
    import corpus_pipeline
    from loomwork.llm.scratch import Scratch

    sf, scratch = "/root/testdata/sf0.001", Scratch(spark, "test")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.save(stage(spark, docs, sf), f"stage-{k}")
        counts.append(docs.count())
        assert k == 4 or docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 100 and counts[4] <= 2 * counts[3]
    assert docs.select("sequence_id", "offset").distinct().count() == counts[5]


def spans_removed(r):
    return r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256


def brute_rows(texts, width=100):
    """What ``brute_removed`` gives, for each of ``texts`` in their order."""
    found = brute_removed(list(enumerate(texts)), width)
    return [(len((t or "").encode()), *found[i]) for i, t in enumerate(texts)]


def test_suffix_with_null_and_repeated_keys(spark):
    rng = np.random.default_rng(41)
    letter = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    one, two, shared = letter(300), letter(400), letter(150)
    rows = [(None, one), (None, one[:200] + two), (None, None), (7, shared + two), (7, one + shared), (7, shared + two), (8, "x" + shared + "y")]
    got = suffix.digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, spans_removed(r)) for r in got) == sorted((k is not None, k or 0, x) for (k, _), x in zip(rows, brute_rows([t for _, t in rows]), strict=True))


def test_suffix_splits_hot_minimizers(spark):
    rng = np.random.default_rng(42)
    letter = lambda n: "".join(rng.choice(list("abcdefghijkl"), n))
    line, tail = letter(60), letter(70)
    texts = [letter(120) + line + (tail if i % 3 == 0 else letter(70)) + letter(40) for i in range(60)] + ["ab" * 300, "ab" * 310, letter(90) + "ab" * 80, "z" * 250]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_rows(texts)
    for hot in (4096, 5, 1):
        got = by_id(suffix.digest(docs, hot=hot))
        assert [spans_removed(got[i]) for i in range(len(texts))] == want, hot


def test_suffix_of_a_long_text(spark):
    rng = np.random.default_rng(43)
    letters = "".join(map(chr, rng.integers(97, 123, 1_300_000)))
    texts = [letters, letters[1_048_500:1_048_900] + "\n" + letters[:120], letters[40:700_000] + "é"]
    got = by_id(suffix.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [spans_removed(got[i])[:3] for i in range(3)] == [(1_300_000, 0, 0), (521, 520, 2), (699_962, 699_960, 1)]


def test_jaccard_with_null_and_repeated_keys(spark):
    rng = np.random.default_rng(51)
    text = lambda: " ".join(f"w{w}" for w in rng.integers(0, 10**6, 60))
    one, two, three, four = text(), text(), text(), text()
    rows = [(3, one), (3, two), (3, two), (5, two + " more"), (None, three), (7, three), (8, four.upper()), (6, four), (9, None), (None, "")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: -1 if x is None else x
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == sorted([(3, 56, 3)] * 3 + [(5, 57, 3), (-1, 56, -1), (7, 56, -1), (8, 56, 6), (6, 56, 6), (9, 0, 9), (-1, 0, -1)])


def test_jaccard_of_a_large_group_and_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(52)
    words = lambda n: [f"w{w}" for w in rng.integers(0, 10**6, n)]
    base, other, long = words(80), words(80), words(3000)
    texts = []
    for i in range(60):  # one group, its ends linked through its middle only
        texts.append(base[: 80 - i % 12] + words(2))
    texts += [other[:50] + words(k) for k in (10, 11, 12, 40)] + [long, long[:2400], long[:1700] + words(1300)]
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    group = list(range(len(texts)))
    for _ in range(4):
        for a in range(len(texts)):
            for b in range(len(texts)):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = by_id(jaccard.join(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")))
    assert [got[i].component_id for i in range(len(texts))] == group


def brute_lines(texts, least=20, far=2):
    """Which lines stay, for each of ``texts`` in their order."""
    first, found = {}, {}
    for i, text in enumerate(texts):
        for j, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                first.setdefault(line, (i, j))
    names, group = list(first), {x: x for x in first}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, a in enumerate(names):
        for b in names[:n]:
            if abs(len(a) - len(b)) <= far and top(a) != top(b) and edits(a, b) <= far:
                group[top(a)] = top(b)
    for x, at in first.items():
        found[top(x)] = min(found.get(top(x), at), at)
    return [[j for j, x in enumerate((t or "").split("\n")) if len(x) < least or found[top(x)] == (i, j)] for i, t in enumerate(texts)]


def test_lines_with_hot_segments_and_long_lines(spark):
    rng = np.random.default_rng(61)
    letter = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    head, long = letter(10), letter(900)
    pool = [head + letter(22) for _ in range(40)]  # one segment, no near lines
    pool += [pool[i][:k] + letter(1) + pool[i][k + 1 :] for i, k in ((0, 3), (0, 20), (1, 31), (2, 15))] + [pool[3] + "x", pool[4][1:], pool[5][:9] + pool[5][11:], pool[6][:9] + "qqq" + pool[6][9:]]
    pool += [long, long[:400] + "é" + long[401:], long[:-2], long[:-3], "short", ""]
    texts = ["\n".join(rng.permutation(pool)[: rng.integers(1, 12)]) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_lines(texts)
    for hot in (64, 2):
        got = by_id(lines.deduplicated(docs, hot=hot))
        for i, text in enumerate(texts):
            assert got[i].text == "\n".join(text.split("\n")[j] for j in want[i]) and got[i]["__removed"] == got[i]["__lines"] - len(want[i]), (hot, i)


def test_lines_with_null_keys_repeated_rows_and_clashing_names(spark):
    one, two = "the first of two long lines", "another one that is long as well"
    rows = [(None, one, 1, "a"), (None, two + "\n" + one, 2, "b"), (4, one + "!", 3, "c"), (4, two, 4, "d"), (5, "x\n" + one + "\n" + "x" * 25, 5, "e"), (5, "x\n" + one + "\n" + "x" * 25, 5, "e"), (6, None, 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, `__hash` string").coalesce(1)
    done = lines.deduplicated(docs)
    got = sorted(((r.doc_id or 0, r.text or "", r.gone, r["__hash"] or "", r["__removed"]) for r in done.collect()), key=str)
    want = brute_lines([one, two + "\n" + one])  # null keys are first; of equal keys a hash of the text decides
    assert done.columns == [*docs.columns, "__lines", "__removed"] and sum(x[4] for x in got if not x[0]) == 1 and want
    assert [x for x in got if x[0]] == [(4, "", 3, "c", 1), (4, "", 4, "d", 1), (5, "x", 5, "e", 2), (5, "x\n" + "x" * 25, 5, "e", 1), (6, "", 6, "", 0)]


def test_mixing_respects_its_cap_and_repeated_and_null_keys(spark):
    rows = [(i % 7 if i % 3 else None, "a" if i < 90 else None, " ".join(["w"] * (i % 40)), i, "x") for i in range(200)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size long, hash string")
    sizes = Counter()
    for r in rows:
        sizes[r[1]] += len(r[2].split())
    for cap, share in ((3, 2.5), (2, 1.5), (1, 1.0)):
        got = mixing.mix(docs, cap=cap, share=share).collect()
        assert len(got) == len(rows) and all(r.taken <= cap * r.size for r in got)
        for size in sizes.values():
            own = [r for r in got if r.source_size == size]
            assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.04)
    done = mixing.mixed(docs, cap=3, share=2.5)
    taken = sum(r.taken for r in mixing.mix(docs, cap=3, share=2.5).collect())
    assert done.columns == docs.columns and sum(len(r.text.split()) for r in done.collect()) == taken


def test_shards_draw_their_sources_multinomially(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    plan = spark.createDataFrame([(1, 500), (2, 300), (3, 199), (4, 1)], "sid int, slots long")
    got = mixing._drawn(plan, 400, "s").collect()
    shards = defaultdict(Counter)
    for r in got:
        shards[r.shard][r.sid] += r["count"]
    assert len(shards) == 400 and all(sum(c.values()) == 100 for c in shards.values())
    for sid, p in ((1, 0.5), (2, 0.3), (3, 0.199), (4, 0.001)):
        counts = np.array([shards[j][sid] for j in range(400)])
        assert abs(counts.mean() - 100 * p) < 5 * np.sqrt(100 * p * (1 - p) / 400) and 0.7 < counts.var() / (100 * p * (1 - p)) < 1.4


def test_passages_whose_parts_come_first_in_several_documents(spark):
    rng = np.random.default_rng(71)
    for _ in range(3):
        words = lambda n: [f"w{w}" for w in rng.integers(0, 10**6, n)]
        shared = words(64)
        texts = [words(20) + shared[:32] + words(20), words(20) + shared[32:] + words(20), words(10) + shared + words(30), words(40) + shared + words(5), shared[:40] + words(30)]
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {(r.doc_id, r.match_doc_id, r.start_word, r.end_word) for r in passages.passages(docs).collect()}
        assert got == {(3, 2, 40, 104)}


def test_passages_of_repeated_rows_and_null_keys(spark):
    rng = np.random.default_rng(72)
    one, two = (" ".join(f"w{w}" for w in rng.integers(0, 10**6, 70)) for _ in range(2))
    rows = [(1, one), (1, one), (2, one), (None, one), (3, two), (4, "x " + two), (4, "x " + two), (5, None), (6, "")]
    got = sorted((r.doc_id, r.start_word, r.end_word, r.match_doc_id) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 0, 70, 1), (4, 1, 71, 3)]


def test_states_with_many_branches_are_compared_whole():
    marks = [chr(200 + i) for i in range(90)]
    for odd in range(0, 90, 7):
        a = object.__new__(secrets.Automaton)
        a.bound, n = 1.0, len(marks)
        a.count, a.ends = [9000] * 2 + [1000] * 2 * n, [0] * 2 + [1000] * n + [0 if i == odd else 1000 for i in range(n)]
        a.next = [{c: 2 + i for i, c in enumerate(marks)}, {c: 2 + n + i for i, c in enumerate(marks)}] + [{}] * 2 * n
        a.count_on = [{c: 1000 for c in on} for on in a.next]
        assert not a._compatible(0, 1)


def test_secrets_against_plain_regular_expressions(spark):
    rng = np.random.default_rng(73)
    pieces = ["token = ", 'API_KEY:"', "password=", "secret : ", "AKIA", "0123456789abcdef" * 2, "Abc+/_.=-9", "é", " ", "\n", "akia", "deadbeef" * 5, "ABCDEFGHIJKLMNOP12", "passwd", "'", "zz"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 40))) for _ in range(300)] + [None, "", "token=" + "a" * 50_000, ("token=abcdefgh1 " * 3000)]
    forms = [(re.compile("(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8), (re.compile("(AKIA[A-Z0-9]+)"), 1, 16), (re.compile("([0-9a-f]+)"), 1, 32)]
    got = by_id(secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))))
    for i, text in enumerate(texts):
        base = sorted((m.start(), k, m.end()) for k, (form, g, least) in enumerate(forms) for m in form.finditer(text or "") if len(m[g]) >= least)
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and set(shown.split(",")) - {""} <= set(got[i].spans.split(","))


def test_passages_with_an_edit_every_few_words(spark):
    rng = np.random.default_rng(74)
    word = lambda: f"w{rng.integers(10**8)}"
    words = lambda n: [word() for _ in range(n)]
    for every in (20, 10):
        rows = []
        for i in range(60):
            text = words(60)
            edited = [word() if (j + every // 2) % every == 0 else w for j, w in enumerate(text)]
            rows += [(2 * i, " ".join(words(20) + text + words(20))), (2 * i + 1, " ".join(words(20) + edited + words(20)))]
        found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(r.match_doc_id == r.doc_id - 1 and r.identity >= 0.75 for r in found) >= 0.95 * 60


def test_passages_cover_every_earlier_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts, spans, seen = sorted((r.doc_id, WORD.findall((r.text or "").translate(lower))) for r in docs.collect()), defaultdict(list), set()
    for r in passages.passages(docs).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    for key, words in texts:
        own = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        assert all(w not in seen or any(s <= i and i + 50 <= e for s, e in spans[key]) for i, w in enumerate(own))
        seen |= set(own)


def test_passages_whose_seeds_come_first_and_nearest_in_fragments(spark):
    rng = np.random.default_rng(91)
    words = lambda n: [f"w{w}" for w in rng.integers(0, 10**7, n)]
    shared = words(80)
    part = lambda a: words(30) + shared[a : a + 24] + words(30)
    # the passage is whole in 8 and 17; every seed of it is in parts of 24 words before 8 and after
    texts = [part(a) for a in range(0, 64, 8)] + [words(25) + shared + words(25)] + [part(a) for a in range(0, 64, 8)] + [words(15) + shared + words(35)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.match_doc_id, r.start_word, r.end_word) for r in passages.passages(docs).collect()}
    assert got == {(17, 8, 15, 95)}


def test_passages_of_a_frequent_phrase_are_told_apart_by_their_surroundings(spark, monkeypatch):
    rng = np.random.default_rng(92)
    words = lambda n: [f"w{w}" for w in rng.integers(0, 10**7, n)]
    phrase, beside = words(20), [words(3) for _ in range(14)]
    # every third word differs beside the phrase, so that no seed but the phrase's is shared
    around = lambda: [w for part in beside[:7] for w in (*part, *words(1))] + phrase + [w for part in beside[7:] for w in (*words(1), *part)]
    texts = [words(40) + phrase + words(40) for _ in range(12)] + [words(9) + around() + words(9)] + [words(40) + phrase + words(40) for _ in range(12)] + [words(5) + around() + words(5)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sizes, judged = [], passages._judged

    def seen(met, *args):
        sizes.append(met.select("doc", "match").distinct().count())
        return judged(met, *args)

    monkeypatch.setattr(passages, "_judged", seen)
    for hot in (4, 1000):  # told apart, and all meet
        assert [(r.doc_id, r.match_doc_id) for r in passages.passages(docs, hot=hot).collect()] == [(25, 12)]
    assert sizes[1] == 1 and sizes[3] == 26 * 25 // 2


def test_stretches_of_one_word_meet_in_step(spark):
    x, y = passages.matches(np.arange(40), np.arange(100, 120))
    assert set(x) == set(range(40)) and len(x) < 100
    x, y = passages.matches(np.array([3, 50]), np.array([7, 90, 200]))
    assert len(x) == 6
    x, y = passages.matches(np.arange(0, 240, 12), np.arange(0, 260, 13))  # other text may lie between, so all meet
    assert len(x) == 400
    texts = ["a b c d e f " * 3 + " ".join(["of"] * 60), " ".join(["x y z u v w"] * 2 + ["of"] * 150), " ".join(["q r s t"] * 3 + ["of"] * 70)]
    got = {(r.doc_id, r.match_doc_id) for r in passages.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {d for d, _ in got} == {1, 2}


def test_hot_keys_are_refined_on_both_sides(spark, tmp_path):
    rng = np.random.default_rng(93)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared = text(10)
    # a middle segment that all hold, and what is beside it: far ones, and near ones of one edit a side or two on one
    lines_ = [text(10) + shared + text(10) for _ in range(12)]
    for base in lines_[:4]:
        lines_ += [base[:3] + "x" + base[4:25] + "y" + base[26:], base[:4] + base[5:27] + "zz" + base[27:29] + base[30:], "xy" + base[2:], base[:-2]]
    table = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines_)], "id long, line string, length int")
    table = table.withColumn("keys", lines.segment_keys(F.col("line"), F.col("length"), 2))
    near = [{i} for i in range(len(lines_))]
    for i in range(len(lines_)):
        for j in range(i):
            if edits(lines_[i], lines_[j]) <= 2:
                one, two = next(s for s in near if i in s), next(s for s in near if j in s)
                if one is not two:
                    near = [s for s in near if s is not one and s is not two] + [one | two]
    want = {i: min(s) for s in near if len(s) > 1 for i in s}
    for hot in (2, 64):
        got = {r.id: r.component for r in lines.line_links(table, lines.Scratch(spark, "test"), 2, hot).collect()}
        assert got == want
    # a side that may have one edit is cut in two, so the middle segment's own line has four finer keys, not nine
    rows = table.limit(1).select("id", "line", "length", F.explode(F.array(*(F.lit(p) for p in range(3)))).alias("pos"), F.lit(7).cast("long").alias("k"))
    sides = rows.select("id", "k", F.lit(True).alias("own"), *lines._sides(F.col("line"), F.col("length"), F.col("pos"), 2))
    counts = sorted(sum(1 for x in r.found if x.k is not None and x.indexed) for r in lines._refined(sides, 2).collect())
    assert counts == [3, 3, 4]
