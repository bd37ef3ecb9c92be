import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import packing, quality
from loomwork.llm.scratch import Scratch
from tests.llm.test_operators import edits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note map<string,int>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Rows of (doc_id, text), with columns of documents and one that can't be ordered."""
    return spark.createDataFrame([(k, t, "en", None if (k or 0) % 3 == 0 else "ab"[(k or 0) % 2], len(t or ""), {"n": i}) for i, (k, t) in enumerate(rows)], SCHEMA)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def prose(seed, n=40):
    return " ".join(f"w{w}" for w in np.random.default_rng(seed).integers(0, 10**6, n))


@pytest.fixture
def sf(spark, tmp_path):
    """A folder whose labels call odd keys good."""
    spark.createDataFrame([(k, k % 2, 0) for k in range(300)] + [(3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def sentence(rng, good):
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    return (" " if good else "### ").join(words)


def brute_scores(spark, docs, labels):
    """(key, sha of the text) -> score: ridge in closed form, folds left out, the isotonic fit by its min-max formula."""
    rows = quality.feature_table(docs, "text", "doc_id", "told").collect()
    label = [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    train = [(np.array(r.x), y, r.doc_id) for r in rows for k, y in label if k == r.doc_id]
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(quality.FOLDS)).alias("f")).distinct().collect()}
    x, y, part = np.array([t[0] for t in train]), np.array([t[1] for t in train], float), np.array([fold[t[2]] for t in train])
    centre, spread, n = x.mean(0), x.std(0), quality.COSINES
    spread[spread < 1e-9] = 1.0
    wide = lambda v: quality.cosines(v, centre, spread, n, 3)
    z = wide(x)

    def solved(own):
        a = np.vstack([z[own], np.sqrt(quality.RIDGE * max(1, own.sum()) / n) * np.eye(n + 1)])
        return np.linalg.lstsq(a, np.concatenate([y[own], np.zeros(n + 1)]), rcond=None)[0]

    raw = np.zeros(len(z))
    for f in range(quality.FOLDS):
        raw[part == f] = z[part == f] @ solved(part != f)
    at = np.clip((raw + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = np.unique(at)
    weight, mean = np.array([(at == b).sum() for b in bins]), np.array([y[at == b].mean() for b in bins])
    average = lambda a, b: (weight[a : b + 1] @ mean[a : b + 1]) / weight[a : b + 1].sum()
    fitted = [max(min(average(a, b) for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    scores = wide(np.array([r.x for r in rows])) @ solved(np.ones(len(z), bool))
    found = np.clip(0.99 * np.interp(scores, -0.5 + (bins + 0.5) * 2 / quality.BINS, fitted) + 0.01 * np.clip((scores + 0.5) / 2, 0, 1), 0, 1)
    return {(r.doc_id, r.told): s for r, s in zip(rows, found, strict=True)}


def test_quality_stage_against_closed_forms(spark, sf):
    rng = np.random.default_rng(1)
    rows = [(k, sentence(rng, k % 2)) for k in range(300)]
    rows += [(301, sentence(rng, True)), (301, sentence(rng, False)), (None, sentence(rng, True)), (None, sentence(rng, False)), (302, None), (302, ""), (5, rows[5][1]), (5, rows[4][1])]
    docs = table(spark, rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = brute_scores(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet"), told="told").collect()
    assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id, r.told]) < 1e-6 for r in got)
    stay = corpus_pipeline.quality_stage(spark, docs, sf)
    assert stay.columns == docs.columns
    assert pairs(stay) == Counter((k, t) for k, t in rows if want[k, sha(t)] >= quality.THRESHOLD)
    assert pairs(stay)[301, rows[300][1]] and not pairs(stay)[301, rows[301][1]]


def brute_line_stage(rows, told, least=20, far=2):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, told[rows[i][1] or ""]))
    seen, out = [], {}
    for i in order:
        text = rows[i][1]
        before = out.get(("done", rows[i][0], text or ""))
        kept = []
        for line in (text or "").split("\n"):
            if not WORD.search(line):
                kept.append(line)
                continue
            near = any(a == line or (min(len(a), len(line)) >= least and abs(len(a) - len(line)) <= far and edits(a, line) <= far) for a in seen)
            if not near:
                kept.append(line)
            seen.append(line)
        out["done", rows[i][0], text or ""] = True
        lost = len(kept) < len((text or "").split("\n"))
        new = "\n".join(kept) if lost else text
        assert before is None or not WORD.search("\n".join(kept))
        if not lost or WORD.search(new):
            out[i] = new
    return Counter((rows[i][0], t) for i, t in out.items() if isinstance(i, int))


def test_line_stage_against_brute_force(spark, sf):
    long = [prose(100 + i, 4) for i in range(12)]
    near = long[0][:5] + "x" + long[0][6:]
    rows = [(1, "short\n" + long[0]), (2, "short\nother\n" + near), (3, None), (3, ""), (4, long[1] + "\n" + long[1] + "\n\n"), (4, long[2]), (4, long[2]), (None, "first of all\n" + long[3]), (7, long[3] + "\nown"), (8, "other"), (9, " \n\t"), (9, "\n".join(long[4:]))]
    told = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    got = corpus_pipeline.line_stage(spark, table(spark, rows), sf)
    assert pairs(got) == brute_line_stage(rows, told)
    assert all(r.n_chars == len(r.text or "") for r in got.collect())


def test_jaccard_stage_against_brute_force(spark, sf):
    a, b, c, d = (prose(i) for i in range(4))
    cases = [[(5, a), (5, a), (5, b), (3, b)], [(5, a), (-3, a), (7, b), (None, b), (None, c), (None, c), (None, d), (None, d + " more"), (None, None), (None, "short"), (9, "short"), (9, "SHORT"), (9, ""), (9, " "), (9, " ")]]

    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for rows in cases:
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).hexdigest()))
        sets = {i: shingles(rows[i][1]) for i in order}
        group = {i: i for i in order}
        for i in order:
            for j in order:
                if sets[i] and sets[j] and group[i] != group[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                    group = {k: group[j] if g == group[i] else g for k, g in group.items()}
        first = {}
        for i in order:
            first.setdefault(group[i], i)
        got = corpus_pipeline.jaccard_stage(spark, table(spark, rows), sf)
        assert got.columns == table(spark, rows).columns
        assert pairs(got) == Counter(rows[i] for i in order if not sets[i] or first[group[i]] == i)
    assert set(pairs(corpus_pipeline.jaccard_stage(spark, table(spark, cases[0]), sf))) == {(5, a), (3, b)}


def test_mixing_and_packing_stages_on_repeated_and_null_rows(spark, sf):
    rows = [(k % 50 if k % 7 else None, " ".join(f"k{k}w{i}" for i in range(k % 90))) for k in range(200)] + [(4, None), (4, ""), (8, "again and again")] + [(8, "again and again")]
    docs = table(spark, rows)
    mix = Scratch(spark, "test").save(corpus_pipeline.mixing_stage(spark, docs, sf), "mix")
    owner = {w: t for _, t in rows for w in WORD.findall(t or "")}
    taken, size = Counter(), Counter(w for _, t in rows for w in WORD.findall(t or ""))
    for r in mix.collect():
        words = WORD.findall(r.text)
        assert words and r.n_chars == len(r.text)
        if "again" not in words:
            source = WORD.findall(owner[words[0]])
            assert [w for w in source if w in set(words)] == words
        taken.update(words)
    assert all(n <= 2 * size[w] for w, n in taken.items()) and abs(sum(taken.values()) / (1.5 * sum(size.values())) - 1) < 0.05
    got = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    encode = packing.Encoder(packing.default_tokenizer())
    assert Counter(r.length for r in got) == Counter(len(encode(t or "")) // 4 + 1 for _, t in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(items)[:i]) for items in bins.values() for i, (o, _) in enumerate(sorted(items)))


@pytest.mark.parametrize("k", range(5))
def test_stages_of_an_empty_table(spark, sf, k):
    assert corpus_pipeline.STAGES[k][1](spark, table(spark, []), sf).count() == 0
