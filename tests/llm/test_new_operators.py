"""Collocations, token alignment and SimHash against brute force, with odd rows in every table."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import alignment, bpe, collocations, language, media, neighbours, packing, quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `n` long, seg string, fp long, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(spark, rows, parts=3):
    """Rows (doc_id, text, lang) with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, x, "s", 1, 2, "x", 3, "y") for i, t, x in rows], DOCS).repartition(parts)


# --- collocations -------------------------------------------------------------------------------------


def collocations_by_brute_force(rows, wanted, longest, least, share):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = collections.defaultdict(list)
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        holders = [q for (x, q), b in candidates.items() if x == lang and len(q) > len(p) and 100 * b >= share * a]
        if any(q[i : i + len(p)] == p for q in holders for i in range(len(q) - len(p) + 1)):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((score, a, " ".join(p), left, right))
    return {(lang, k, phrase, a, left, right, n[lang], score) for lang, found in out.items() for k, (score, a, phrase, left, right) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1], x[2].encode()))[:wanted], 1)}


def phrase_rows(seed=3, n=300):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "GAMMA", "délta", "eps", "ζeta", "e.g", "a", "b", " ", "x" * 70]
    glue = [" ", "  ", "\t", ". ", ", ", "\n", ";", "!?"]
    rows = [("".join(rng.choice(vocab) + rng.choice(glue) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    rows += [(None, "en"), ("", "en"), (" \t ", None), ("...", "xx"), ("alpha beta gamma", "en")] * 12
    return rows + [("alpha beta gamma delta " * 400, "en"), ("one two, " * 300, None)]


def mined(spark, rows, **more):
    out = collocations.mined(table(spark, [(k, t, x) for k, (t, x) in enumerate(rows)]), **more).collect()
    return {tuple(r) for r in out}, len(out)


@pytest.mark.parametrize("cell_bytes,stretch,share", [(64, 1 << 23, 100), (64, 50, 60), (1 << 40, 1000, 100)])
def test_collocations(spark, monkeypatch, cell_bytes, stretch, share):
    """In few cells nearly all n-grams share theirs with a frequent one: more survive, and the result is the same."""
    if cell_bytes > 64:
        monkeypatch.setattr(collocations, "LEAST_CELLS", 64)
    rows = phrase_rows()
    got, n = mined(spark, rows, wanted=40, least=12, share=share, cell_bytes=cell_bytes, stretch=stretch)
    want = collocations_by_brute_force(rows, 40, 5, 12, share)
    assert got == want and n == len(want) > 12


def test_collocations_of_nothing(spark):
    assert mined(spark, [])[1] == 0 and mined(spark, [(None, None), ("a b", "en")])[1] == 0


def test_sketches_lose_nothing():
    """A merged cell is at least the count of each n-gram in it, so all frequent ones survive."""
    rows = phrase_rows(n=100)
    texts, langs = pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())
    rows_of = list(collocations.stretches(texts, langs, 200))
    counted = collections.Counter(h for s in rows_of for h in np.concatenate([g[0] for g in collocations.grams(*s, longest=5)]).tolist())
    merged = {}
    for batch in collocations._sketched(5, 9, 256, None, 200)(iter([pa.RecordBatch.from_arrays([texts, langs], ["text", "lang"])])):
        for part, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cells = merged.setdefault(part >> 40, np.zeros(256, np.int64))
            cells[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u2")
    for s in rows_of:
        for kind, (h, _) in enumerate(collocations.grams(*s, longest=2)):
            for row in range(collocations.DEPTH):
                cell = merged[kind * collocations.DEPTH + row][collocations.cells(h, kind, row, 256)]
                assert all(c >= min(counted[x], 9) for c, x in zip(cell.tolist(), h.tolist(), strict=True))


def test_collocation_score_passes_64_bits(spark):
    big = spark.createDataFrame([("en", 0, "", 5 * 10**15), ("en", 1, "a", 4 * 10**14), ("en", 1, "b", 3 * 10**14), ("en", 2, "a b", 2 * 10**14)], "lang string, k int, phrase string, n long")
    r = collocations.scored(big).first()
    assert r["score"] == 1000 * 2 * 10**14 * 5 * 10**15 // (4 * 10**14 * 3 * 10**14)


def test_collocation_oracle(spark, sf_dir, monkeypatch):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = collocations.op11_collocations(spark, sf_dir).toPandas()
    want = c.execute(collocations.ORACLE).df()
    assert sorted(got.itertuples(index=False)) == sorted(want[list(got.columns)].itertuples(index=False)) and len(got)


# --- alignment ----------------------------------------------------------------------------------------


def alignment_by_brute_force(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=packing.tokenizer_path("piece_bpe_32k.model"))
    byte = {c: k for k, c in enumerate(bpe.byte_alphabet())}
    of_a = {i: bytes(byte[c] for c in s) for s, i in t.get_vocab(with_added_tokens=False).items() if all(c in byte for c in s)}
    of_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    found, count = [], collections.Counter()
    for doc_id, text in docs:
        a, b, groups, links = [], [], [], []
        if text:
            raw, a, b = (" " + text).encode(), t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            if b"".join(of_a[i] for i in a) != raw or b"".join(of_b[i] for i in b) != raw:
                a, b = [], []
        ends = [np.cumsum([len(of[i]) for i in ids]).tolist() for ids, of in ((a, of_a), (b, of_b))]
        i = j = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            for x in range(i, p):
                for y in range(j, q):
                    if max(ends[0][x - 1] if x else 0, ends[1][y - 1] if y else 0) < min(ends[0][x], ends[1][y]):
                        links.append((a[x], b[y]))
            i, j = p, q
        count.update(set(links))
        found.append((doc_id, a, b, groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted((d or -1, len(a), len(b), len(g), len(x), sum(count[y] == best[y[0]] for y in x), sum(count[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, x in found)


ODD = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "foo", "é", "▁", "日本", "　", " ", " ", "\x00", "<s>", "<|endoftext|>", "<0x41>", ".", "'s", "123", "𝒳", "́", "\x1c", "᠎", "​", "-", "_", "ing", " the", " der", "﻿"]


def odd_rows(n=1200):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 14)))) for k in range(n)]
    rows += [(9001, None), (9002, " "), (9003, "\n"), (9004, "a "), (9005, "a  "), (9006, " a \n b \r c "), (9007, "x" * 3000), (9008, " " * 2000), (9009, "a\n" * 900), (9010, "foo bar"), (9010, "foo bar"), (None, "foo bar")]
    return rows


@pytest.mark.parametrize("bundle,long_text", [(1 << 23, 1 << 22), (2000, 100)])
def test_alignment(spark, monkeypatch, bundle, long_text):
    monkeypatch.setattr(alignment, "LONG_TEXT", long_text)
    monkeypatch.setattr(alignment, "SHARD_BYTES", 1 << 24 if bundle > 2000 else 50)
    rows = odd_rows()
    out, pairs = alignment.aligned_documents(table(spark, [(i, t, "en") for i, t in rows]), bundle=bundle)
    got = sorted((r["doc_id"] or -1, *r[1:]) for r in out.collect())
    assert got == alignment_by_brute_force(rows)
    p = pairs.toPandas()
    assert not p.duplicated(["a", "b"]).any()
    assert (p.groupby("a")["n"].transform("max") == p["n"]).equals(p["best"])


def test_alignment_of_nothing(spark):
    out, pairs = alignment.aligned_documents(table(spark, []))
    assert out.count() == 0 and pairs.count() == 0


def test_breaks_are_verified():
    assert alignment.breaks(["a", " a", "\n\n"], [" b", "  ", "b"]) == " \n\t\r"
    assert alignment.breaks(["a", "a b"], [" b"]) == "\n\t\r"  # A merges across a space
    assert alignment.breaks(["a"], ["b ", ";\r", " \t"]) == "\n"  # B across a space and a return, and a tab behind a space
    assert alignment.segments("").findall("a b\nc") == ["a b\nc"]


def test_segments_make_up_the_text():
    for cuts in (" ", " \n\t", "\n"):
        pattern = alignment.segments(cuts)
        for _, text in odd_rows(300):
            found = pattern.findall(" " + (text or ""))
            assert "".join(found) == " " + (text or "") and all(s[0] in cuts and not found[k][-1].isspace() for k, s in enumerate(found[1:]))


# --- simhash ------------------------------------------------------------------------------------------


def fingerprint(text):
    import xxhash

    w = WORD.findall(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, most=3):
    """Components of the fingerprints, by brute force."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(list(nodes), np.uint64)
    for x in nodes:
        for y in arr[np.bitwise_count(arr ^ np.uint64(x)) <= most].tolist():
            root[find(x)] = find(y)
    return {x: find(x) for x in nodes}


def simhash_rows():
    rng = random.Random(9)
    vocab = [a + b for a in ("ka", "Lo", "mi", "TER", "sün", "bri") for b in ("", "na", "po", "st", "ing")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(400)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one\ttwo ", "one two three", *(prose(rng.randint(3, 60)) for _ in range(60)), base, base, base.upper(), base.replace(" ", "\n ")]
    for _ in range(60):
        w = base.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts.append(base + " " + base + " " + prose(3000))
    return [(k, t) for k, t in enumerate(texts)] + [(5, "one two"), (None, "one two"), (None, base), (None, prose(9)), (77, "an id that comes twice, with another text")]


@pytest.mark.parametrize("stretch,many,at_home", [(1 << 22, 1 << 28, 1 << 16), (64, 0, 1), (7, 1 << 28, 1)])
def test_simhash(spark, stretch, many, at_home):
    """Also in tiny stretches, with two stretches of the code dealt, and with parts of one fingerprint."""
    rows = simhash_rows()
    got = [tuple(r) for r in simhash.join(table(spark, [(i, t, "en") for i, t in rows]), stretch=stretch, many=many, at_home=at_home).collect()]
    fps = [fingerprint(t) for _, t in rows]
    of = classes(set(fps))
    least = {}
    for (i, _), x in zip(rows, fps, strict=True):
        least[of[x]] = min((v for v in (i, least.get(of[x])) if v is not None), default=None)
    want = [(i, f"{x:016x}", least[of[x]]) for (i, _), x in zip(rows, fps, strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert len(set(of.values())) < len(of)  # near ones that differ are linked


def test_simhash_of_nothing(spark):
    assert simhash.join(table(spark, [])).count() == 0


@pytest.mark.parametrize("factor", simhash.FACTORS)
def test_codes_are_perfect(factor):
    """Each syndrome has one error pattern within the radius, and all words one home that is near."""
    length, _, radius = factor
    by_byte, pattern, _, _ = simhash.code(*factor)
    assert len(np.unique(pattern)) == len(pattern) and np.bitwise_count(pattern).max() == radius
    word = np.random.default_rng(1).integers(0, 1 << length, 5000).astype(np.uint32)
    home = word ^ pattern[simhash.syndrome(word, by_byte)]
    assert not simhash.syndrome(home, by_byte).any()


@pytest.mark.parametrize("factors", [range(1), range(2), range(3), range(1, 2)])
def test_copies_reach_the_homes_of_all_points_near(factors):
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, 300).astype(np.uint64)
    row, anchor, used = simhash.reached(fp, np.zeros(300, np.int64), factors)
    least = {(r, a): u for r, a, u in zip(row.tolist(), anchor.tolist(), used.tolist(), strict=True)}
    for n in range(4):
        for _ in range(40):
            point = fp.copy()
            for _ in range(n):
                point ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
            assert all(least[k, a] <= n for k, a in enumerate(simhash.homes(point, factors).tolist()))


@pytest.mark.parametrize("rounds", [1, 7])
def test_links_connect_a_crowd(rounds):
    """Some hundred fingerprints around one point: as connected as all pairs make them, with few links."""
    rng = np.random.default_rng(4)
    flips = rng.integers(0, 64, (400, 3))
    fp = np.unique(np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64), axis=1) ^ np.uint64(0x0F0F12345678ABCD))
    met = simhash.Met(fp, range(1, 2))
    found = [x for part in np.array_split(fp, rounds) for x in met.links(part, np.zeros(len(part), np.int64))]
    root = {x: x for x in fp.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in found:
        root[find(u)] = find(v)
    # At one anchor of the second stretch meet those that have it as home with all that reach it.
    cell, own = simhash.homes(fp, range(1, 2)), classes(fp.tolist())
    for c in np.unique(cell):
        mine = fp[cell == c].tolist()
        alone = classes(mine)
        assert all(find(x) == find(y) for x in mine for y in mine if alone[x] == alone[y])
    assert all(own[u] == own[v] for u, v in found) and len(found) < 2 * len(fp)


# --- mends of earlier operators -----------------------------------------------------------------------


@pytest.mark.parametrize("html", ["<![foo<bar]]><p>a", "<![foo", "<![", "<![CDATA[x]]>y", "<![if x]>y<![endif]>", "<![if", "<![ 1>b", "<!foo<p>a", "<!-- a", "<!", "<!>", "<!doctype", "<!DOCTYPE [<!x", "</", "<p", "<img src='a", "<?x", "&#xFFFFFFFF;", "<script>", "<figure><figcaption>x", "</figcaption></figure>"])
def test_malformed_html(html):
    items = media.parse(f"<p>before</p>{html}")
    assert items[0]["text"].startswith("before") and [x["pos"] for x in items] == list(range(len(items)))


def test_any_bytes_are_parsed():
    rng = random.Random(2)
    bits = ["<", ">", "<!", "<![", "]]>", "<!--", "-->", "</", "<p", "<img src=", "<figure>", "<figcaption>", "<script>", "</script>", "'", '"', "=", "&", "&#", ";", " ", "a", "[", "é", "\x00", "<?", "<!doctype", "<video>", "<source src=x>"]
    for _ in range(10_000):
        media.parse("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))))
    for _ in range(2000):
        media.parse(rng.randbytes(60).decode("latin1"))


def near_by_brute_force(rows, queries, wanted):
    """The best candidates of each query id, each with its largest score over all its vectors."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = (u[ids == q] @ u.T).max(axis=0)
        best = {int(i): max(s[ids == i]) for i in set(ids.tolist()) - {q}}
        out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:wanted]
    return out


def test_an_id_with_several_vectors_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[5].tolist()), (7, x[7].tolist()), (7, x[7].tolist()), (9, x[10].tolist())]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, score double, node int").repartition(3)
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", F.pmod(F.col("id"), F.lit(5)) == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = near_by_brute_force(rows, range(0, 30, 5), 5)
    assert got.keys() == want.keys() and all([i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)
    assert got[0][0] == (5, pytest.approx(1.0))


def test_the_graph_grows_as_far_as_it_must(spark, monkeypatch):
    """From 4 neighbours a node on, with poor cells and a narrow beam: both grow until the probes find theirs."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    monkeypatch.setattr(neighbours, "CELL_MOST", 16)
    monkeypatch.setattr(neighbours, "BEAM", 6)
    x = np.random.default_rng(6).standard_normal((1500, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = neighbours.saved(neighbours.nodes_of(neighbours.usable(df, "vec_id", "embedding"), 5), "nodes")
    graph = neighbours.graph_of(nodes, k=4, trees=1)
    assert neighbours.recall_of(graph, 1500) >= neighbours.RECALL
    queries = nodes.select(F.col("ids")[0].alias("id"), "node").where("id % 10 = 0")
    short = neighbours.saved(neighbours.search(nodes, graph, queries, 5, 6, 1), "found")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-(u @ u.T - 2 * np.eye(1500)), axis=1)[:, :5]
    share = lambda rows: sum(r["vec_id"] in best[r["query_id"]] for r in rows) / 750
    real = share(short.collect())
    assert abs(neighbours.recall_of_search(short, nodes, queries) - real) < 0.03
    monkeypatch.setattr(neighbours, "OPEN", 1)
    monkeypatch.setattr(neighbours, "GRAPH_K", 4)
    assert share(neighbours.nearest(df, "vec_id", "embedding", F.pmod(F.col("id"), F.lit(10)) == 0).collect()) >= 0.9


def test_copies_of_a_vector_count_in_the_recall(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((40, 6)), 4, axis=0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = neighbours.saved(neighbours.nodes_of(neighbours.usable(df, "vec_id", "embedding"), 5), "nodes")
    queries = nodes.select(F.explode("ids").alias("id"), "node")
    found = neighbours.saved(neighbours.search(nodes, neighbours.graph_of(nodes), queries, 5), "found")
    assert neighbours.recall_of_search(found, nodes, queries) == 1.0
    assert neighbours.recall_of_search(found.where("rank > 1"), nodes, queries) == pytest.approx(0.8)


def test_the_graph_is_fitted_on_leaders_and_every_row_is_listed(spark, monkeypatch):
    """Of 6000 vectors about 200 get a graph, which was that of all of them before; every vector is on lists and found."""
    monkeypatch.setattr(neighbours, "LEAST_LEADERS", 200, raising=False)
    monkeypatch.setattr(neighbours, "ENTRIES", 32, raising=False)
    monkeypatch.setattr(neighbours, "TILE", 50, raising=False)
    monkeypatch.setattr(neighbours, "BEAM", 4)
    fitted, listed = [], []
    real = neighbours.graph_of
    monkeypatch.setattr(neighbours, "graph_of", lambda nodes, *a, **b: (fitted.append(nodes.count()), real(nodes, *a, **b))[1])
    x = np.random.default_rng(9).standard_normal((6000, 12))
    x[:900] = x[0] + 0.01 * x[:900]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::20] @ u.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -2
    best = np.argsort(-s, axis=1)[:, :5]
    got = neighbours.nearest(df, "vec_id", "embedding", F.pmod(F.col("id"), F.lit(20)) == 0).collect()
    assert len(fitted) == 1 and 120 < fitted[0] < 320
    assert len(got) == 1500 and sum(r["vec_id"] in best[r["query_id"] // 20] for r in got) >= 0.9 * 1500
    assert all(abs(r["score"] - u[r["query_id"]] @ u[r["vec_id"]]) < 1e-12 for r in got)
    nodes = neighbours.saved(neighbours.nodes_of(neighbours.usable(df, "vec_id", "embedding"), 5), "nodes")
    leaders = neighbours.Leaders(real(neighbours.saved(neighbours.leaders_of(nodes, 6000), "leaders")))
    for r in neighbours.lists_of(nodes, leaders).collect():
        listed += np.frombuffer(r["keys"], np.int64).tolist()
    assert sorted(listed) == sorted([r["node"] for r in nodes.select("node").collect()] * neighbours.HOMES)


def test_both_zeros_are_one_vector(spark):
    for kind in ("float", "double"):
        df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [-0.0, 1.0]), (2, [1.0, 0.5])], f"vec_id long, embedding array<{kind}>")
        assert sorted(r["ids"] for r in neighbours.nodes_of(neighbours.usable(df, "vec_id", "embedding"), 5).collect()) == [[0, 1], [2]]


# --- classifiers against dense and plain versions -----------------------------------------------------


def labelled(spark, n=260):
    rng = random.Random(12)
    texts = [(" ".join(rng.choice(["alpha", "beta", "gamma", "Delta.", "is", "of"]) for _ in range(rng.randint(5, 60))), 1) if k % 2 else ("".join(rng.choice("@#$%&*!0123 \n") for _ in range(rng.randint(10, 200))), 0) for k in range(n)]
    docs = table(spark, [(k, t, "en") for k, (t, _) in enumerate(texts)])
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, quality int")
    return texts, docs, labels


def test_quality_equals_a_dense_discriminant(spark):
    """numpy.cov, slogdet and solve on the same statistics."""
    import zlib

    texts, docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    x = quality.statistics(pa.array([t for t, _ in texts]))
    y = np.array([label for _, label in texts])
    learn = np.array([zlib.crc32(str(k).encode()) % 3 != 1 for k in range(len(texts))])
    mean, scale = x[learn].mean(axis=0), x[learn].std(axis=0)
    scale[scale < 1e-5] = 1
    z = np.clip((x - mean) / scale, -12, 12)
    own = (x - mean) / scale  # moments are those of values that aren't clipped
    p = x.shape[1]
    parts = [own[learn & (y == k)] for k in (0, 1)]
    covs = [np.cov(v, rowvar=False, bias=True) for v in parts]
    pooled = sum(len(v) * c for v, c in zip(parts, covs, strict=True)) / learn.sum()
    density = []
    for v, c in zip(parts, covs, strict=True):
        s = (1 - quality.POOL) * c + quality.POOL * pooled
        s = (1 - quality.RIDGE) * s + quality.RIDGE * np.trace(s) / p * np.eye(p)
        d = z - v.mean(axis=0)
        prior = (len(v) + quality.PRIOR_ROWS) / (learn.sum() + 2 * quality.PRIOR_ROWS)
        density.append(np.log(prior) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d * np.linalg.solve(s, d.T).T).sum(axis=1))
    difference = (density[1] - density[0]) / p
    assert np.allclose(model.difference(x) + model.shift, difference, atol=1e-6)
    # The shift is one of the cuts with the fewest errors.
    errors = lambda cut: np.mean(difference[learn & (y == 1)] < cut) + np.mean(difference[learn & (y == 0)] >= cut)
    assert errors(model.shift) <= min(map(errors, quality.EDGES)) + 1e-9
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in quality.score(docs, model).collect()}
    d = difference - model.shift
    assert all(got[k] == (not learn[k], pytest.approx(0.5 + 0.5 * d[k] / (1 + abs(d[k])), abs=1e-6), int(d[k] >= 0)) for k in range(len(texts)) if abs(d[k]) > 1e-5)


def ftrl_by_hand(rows, n_langs, features):
    """Follow the regularised leader, coordinate by coordinate."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i, c):
        if abs(z[i, c]) <= language.L1:
            return 0.0
        sign = 1 if z[i, c] > 0 else -1
        return -(z[i, c] - sign * language.L1) / ((language.BETA + n[i, c] ** 0.5) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for y, at, x in rows:
            items = [*zip(at.tolist(), x.tolist(), strict=True), (features, 0.1)]
            w = {(i, c): weight(i, c) for i, _ in items for c in range(n_langs)}
            s = [sum(v * w[i, c] for i, v in items) for c in range(n_langs)]
            e = np.exp(np.array(s) - max(s))
            p = e / e.sum()
            for i, v in items:
                for c in range(n_langs):
                    g = v * (p[c] - (c == y))
                    step = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / language.ALPHA
                    z[i, c] += g - step * w[i, c]
                    n[i, c] += g * g
    return {(i, c): weight(i, c) for i, c in list(z)}


def test_language_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        at = np.sort(rng.choice(60, 12, replace=False))
        x = rng.random(12)
        rows.append((k % 3, at, x / np.sqrt((x**2).sum())))
    weights, bias = language.train(rows, 3)
    want = ftrl_by_hand(rows, 3, language.FEATURES)
    assert all(abs(weights[i, c] - want.get((i, c), 0.0)) < 1e-9 for i in range(60) for c in range(3))
    assert np.allclose(bias, [0.1 * want.get((language.FEATURES, c), 0.0) for c in range(3)]) and (weights[:60] == 0).any() and not weights[60:].any()
    model = language.Model(["a", "b", "c"], np.ones(language.FEATURES), weights, bias)
    held = [(y, at, x) for y, at, x in rows[::3]] + [((rows[0][0] + 1) % 3, *rows[0][1:])]

    def loss(t):
        total = 0.0
        for y, at, x in held:
            s = (x @ weights[at] + bias) / t
            total -= s[y] - np.log(np.exp(s - s.max()).sum()) - s.max()
        return total / len(held)

    grid = np.geomspace(0.1, 5, 60)
    assert language.temperature(model, held) == pytest.approx(grid[np.argmin([loss(t) for t in grid])])
