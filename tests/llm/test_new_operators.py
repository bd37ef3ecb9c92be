import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import alignment, collocations, jaccard, queries, superminhash
from loomwork.llm import textops as T

SCHEMA = "doc_id long, text string, lang string, n_chars long, size int, segment string, token string, n int, f int, hash int, words string"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, 0, 0, "x", "y", 0, 0, 0, "z") for k, t, lang in rows], SCHEMA).repartition(3)


def corpus(seed=0, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(25)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = [prose(int(rng.integers(20, 90))) for _ in range(n)]
    for t in texts[:12]:
        w = t.split()
        for edits in range(4):
            x = list(w)
            for i in rng.integers(0, len(x), edits):
                x[i] = "edited"
            texts.append(" ".join(x))
    texts += [None, "", " \n\t", "one", "ONE", "two Words", "a,b;c. d\n\ne", "É à la É à la", "word " * 3000, "x" * 20_000, "\x1f odd space　wide \x0b\x0c", "▁ bad", "ok ▁"]
    return [(None if i % 29 == 7 else i, t, [None, "und", "en", "dé"][i % 4]) for i, t in enumerate(texts)]


def sets_of(rows, k):
    out = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def components(rows, k, percent):
    sets = sets_of(rows, k)
    label = list(range(len(rows)))
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        before = list(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[label[i]].append(r[0])
    least = {c: None if None in v else min(v) for c, v in low.items()}
    return sorted(((r[0], len(sets[i]), least[label[i]], r[0] == least[label[i]]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_superminhash_against_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [rows[0], rows[5], (3, "another text of a key that comes twice", None)]
    got = superminhash.near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == components(rows, 4, 80)


def test_superminhash_of_an_empty_table_and_of_large_blocks(spark, monkeypatch):
    assert superminhash.near_duplicates(table(spark, [])).count() == 0
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # several blocks a bucket
    rows = corpus(2, 24)
    got = superminhash.near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == components(rows, 4, 80)


def walked(elements, places):
    """A signature element by element, with the permutation written out."""
    out = [1 << 32] * places
    for e in elements:
        order = list(range(places))
        for step in range(places):
            draw = int(T.mix(np.array([e], np.uint64) + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[0])
            to = step + ((draw >> 32) * (places - step) >> 32)
            order[step], order[to] = order[to], order[step]
            out[order[step]] = min(out[order[step]], step << 24 | draw & 0xFFFFFF)
    return out


def test_signatures_with_and_without_early_stopping():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 2, 5, 40, 300, 900]
    first = np.concatenate([[0], np.cumsum(sizes)])
    found = rng.integers(0, 1 << 63, first[-1], dtype=np.uint64)
    made = superminhash.signatures(found, first, 32)
    for i in range(1, len(sizes)):
        assert made[i].tolist() == walked(found[first[i] : first[i + 1]], 32)


def test_estimates_vary_less_than_independent_ones():
    rng = np.random.default_rng(1)
    misses = []
    for _ in range(300):
        v = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        one, two = superminhash.signatures(np.concatenate([v[:50], v[10:]]), np.array([0, 50, 100]), 128)
        misses.append((one == two).mean() - 40 / 60)
    assert abs(np.mean(misses)) < 0.01 and np.var(misses) < 0.8 * (40 / 60) * (20 / 60) / 128


def test_span_hashes_tell_patterns_apart():
    one = np.array([bin(i).count("1") & 1 for i in range(1024)], np.uint8) + 97
    data = np.concatenate([one, 195 - one])
    a, b = T.span_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert a != b
    text = np.frombuffer(b"abcabc\0abc\0\0abcdefghiabcdefghi", np.uint8)
    h = T.span_hashes(text, np.array([0, 3, 7, 7, 12, 21, 5, 5]), np.array([3, 6, 10, 11, 21, 30, 5, 6]))
    assert h[0] == h[1] == h[2] != h[3] and h[4] == h[5] and len(set(h.tolist())) == 5


def phrases(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(Fraction(10**6 * a * a, f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            if len(p) == 3 or not any(len(q) == 3 and m == lang and c >= least and p in (q[:2], q[1:]) and 100 * c >= 50 * a for (m, q), c in f.items()):
                out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def test_collocations_against_brute_force_and_sql(spark, monkeypatch):
    rows = corpus(3, 80) + [(1, "x y z. x y z! x y z x", "en")] * 6
    df = table(spark, rows)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(rows)
    assert want and sorted(map(tuple, collocations.collocations(df).select(columns).collect())) == want
    with duckdb.connect() as c:
        documents = df.toPandas()  # noqa: F841
        assert sorted(c.execute(f"select {', '.join(columns)} from ({collocations.ORACLE_SQL})").fetchall()) == want
    monkeypatch.setattr(collocations, "CODES", 7)  # most words without a code
    assert sorted(map(tuple, collocations.collocations(df, top=5).select(columns).collect())) == phrases(rows, top=5)
    assert collocations.collocations(table(spark, [])).count() == collocations.collocations(table(spark, [(1, None, None), (2, "", "en")])).count() == 0


def test_keys_of_phrases_and_an_open_stack():
    words = np.array([[5, 5, 3, 1 << 63 | 9], [7, 1 << 63 | 2, 0, 4], [1 << 63, 0, 0, 0]], np.uint64)
    assert (collocations.unpacked(collocations.packed(words)) == words).all()
    stack, found = collocations.Stack(), Counter()
    suffixes = sorted(((a, b, c) for a in (1, 2) for b in (0, 1, 2) for c in (0, 3, 4) if b or not c), reverse=True)
    for at in range(0, len(suffixes), 3):  # prefixes stay open across batches
        for w, n in stack.push(np.array(suffixes[at : at + 3], np.uint64).T, np.ones(len(suffixes[at : at + 3]), np.int64)):
            found.update({tuple(x): int(c) for x, c in zip(w.T.tolist(), n, strict=True)})
    for w, n in stack.close():
        found.update({tuple(w[:, 0].tolist()): int(n[0])})
    want = Counter((*s[:k], *[0] * (3 - k)) for s in suffixes for k in range(1, 4) if s[k - 1])
    assert found == want


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_001, 4_000_000_007, 9_000_000_011
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // (left * right)


def encoded(rows):
    """Brute force: whole texts through both tokenizers."""
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two, size = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), alignment._pair(alignment._default_paths())
    docs = []
    for k, t, _ in rows:
        raw = (" " + (t or "")).encode()
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        if b"".join(size.bytes_one[i] for i in a) != raw or b"".join(size.bytes_two[i] for i in b) != raw:
            a, b = [], []
        ea, eb = np.cumsum([len(size.bytes_one[i]) for i in a]).tolist(), np.cumsum([len(size.bytes_two[i]) for i in b]).tolist()
        links, j = [], 0
        for i, (s, e) in enumerate(zip([0, *ea], ea, strict=False)):
            while j < len(eb) and eb[j] <= s:
                j += 1
            links += [(a[i], b[x]) for x in range(j, len(b)) if ([0, *eb])[x] < e][: e - s + 1] if len(b) < 500 else []
            if len(b) >= 500:
                x = j
                while x < len(b) and (eb[x - 1] if x else 0) < e:
                    links.append((a[i], b[x]))
                    x += 1
        both = [0, *sorted(set(ea) & set(eb))]
        groups = [",".join(str(i) for i, e in zip(a, ea, strict=True) if s < e <= t_) + "|" + ",".join(str(i) for i, e in zip(b, eb, strict=True) if s < e <= t_) for s, t_ in zip(both, both[1:], strict=False)] if len(a) < 800 else None
        docs.append((k, a, b, both, links, groups))
    count = Counter(x for d in docs for x in d[4])
    best = defaultdict(int)
    for (_, j), c in count.items():
        best[j] = max(best[j], c)
    return [(k, len(a), len(b), len(both) - 1, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") if groups is not None else None) for k, a, b, both, links, groups in docs]


def test_alignment_against_whole_texts(spark, monkeypatch):
    rows = [r for r in corpus(4, 30) if r[1] is None or len(r[1]) < 15_000]
    rows += [(900 + i, t, None) for i, t in enumerate(["<|endoftext|> <s> </s>", "  lead", "tail  \n", " ", "\n", "\n\na\n \n b", ";\r\n x {\r y", "don't “quote” ’s", "日本語 テキスト\n🙂🙂 ok", "é" * 300 + " à la", "w  　 v\u0085 u  t"])]
    rows += [rows[0], rows[0]]
    monkeypatch.setattr(alignment, "SLICE", 2000)  # several slices, some of one text
    got = sorted(map(tuple, alignment.alignment(table(spark, rows)).collect()), key=str)
    want = sorted(encoded(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: str(r[:7])), sorted(want, key=lambda r: str(r[:7])), strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])
    assert any(w[1] == 0 for w in want) and alignment.alignment(table(spark, [])).count() == 0


def test_cuts_stay_where_no_token_reaches_over():
    pair = alignment._pair(alignment._default_paths())
    raw = " a b  c\n d\n\ne\r f　 g;\r h".encode()
    data = np.frombuffer(raw, np.uint8)
    parts = [raw[a:b] for a, b in zip([0, *pair.cuts(data)], [*pair.cuts(data), len(raw)], strict=True)]
    assert b"".join(parts) == raw and parts[:2] == [b" a", " b  c".encode()] and all(p[:1] in b" \n" for p in parts)


def test_queries_are_registered():
    assert {"op11_superminhash", "op12_alignment", "op13_collocations"} <= set(queries.QUERIES) and set(queries.ORACLE_SQL) == {"op13_collocations"}


@pytest.mark.parametrize("name", ["jaccard", "superminhash", "lines"])
def test_members_are_labelled_once_a_step(spark, monkeypatch, name):
    from loomwork.llm import lines
    from loomwork.llm.scratch import Scratch

    rng = np.random.default_rng(81)
    base = rng.integers(0, 10**6, 60).tolist()
    rows = [(i, " ".join(f"w{w}" for w in base[:j] + [10**7 + i] + base[j + 1 :])) for i, j in enumerate(rng.integers(0, 60, 40).tolist())]
    seen, save = {}, Scratch.save

    def counted(self, df, table, *args):
        seen[table] = df._jdf.queryExecution().optimizedPlan().toString().count("LeftOuter")
        return save(self, df, table, *args)

    monkeypatch.setattr(Scratch, "save", counted)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if name == "lines":
        assert lines.deduplicated(docs, hot=4).agg(F.sum("__removed")).first()[0] >= 0
    else:
        found = {"jaccard": jaccard.join, "superminhash": superminhash.near_duplicates}[name](docs)
        assert {r.component_id for r in found.collect()} == {0}
    opened = {t: n for t, n in seen.items() if t.startswith(("open", "labels"))}
    assert sum("labels" in t for t in opened) >= 1 and max(opened.values()) == 1
    assert all(n == 0 for t, n in opened.items() if "labels" not in t)
