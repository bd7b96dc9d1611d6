"""The operators against brute force, exact round trips or held-out accuracy, with odd rows in every table."""

import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import bpe, chat, components, jaccard, language, media, neighbours, packing, quality, registry, substring, urls
from quantloom.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `__starts` string, score double, bits int"
random.seed(11)
VOCAB = [w + v for w in ("ka", "lo", "mi", "ter", "sun", "bri") for v in ("", "na", "po", "st", "ing", "u")]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


BASE = prose(160)
SHARED = prose(60)


def edited(text, every):
    w = text.split()
    return " ".join(f"x{k}" if k % every == every - 1 else x for k, x in enumerate(w))


def make_rows():
    texts = [prose(random.randint(5, 120)) for _ in range(30)]
    texts += [BASE, BASE, BASE.upper(), edited(BASE, 159), edited(BASE, 80), edited(BASE, 20), BASE + " more words here"]
    texts += [f"{prose(20)} {SHARED} {prose(15)}" for _ in range(4)] + [SHARED]
    texts += [None, "", " \n\t", "one", "two words", "three words here", "one", "\x00 \u00a0\u2003 é ß \U0001f600", "a " * 3000, "word" * 20000, "12345 67 !!!", "日本語 テキスト です"]
    docs = [(k, t, "en" if t else None, "s", len(t or ""), "clash", 1.0, 7) for k, t in enumerate(texts)]
    return docs + [docs[3], docs[30], (None, BASE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


ROWS = make_rows()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return (text or "").encode().split()


# -- words


def test_words_and_windows():
    texts = ["Ab cd\tef", None, "", "  x ", "a b c d e f", "é\u00a0b \x0bq"]
    h, start, end, first = W.words(*W.utf8(pa.array(texts)), lower=True)
    assert list(np.diff(first)) == [len(split(t)) for t in texts]
    assert len({*h}) == len({w.lower() for t in texts for w in split(t)})
    sets = W.gram_sets(h, first, 3)
    assert [len(s) for s in sets] == [1, 0, 0, 1, 4, 1]
    parts = [W.words(d, o, True)[0] for _, _, d, o in W.blocks(pa.array(texts), 5)]
    assert (np.concatenate(parts) == h).all()


def test_words_and_windows_of_a_thue_morse_sequence_differ():
    """Sequences that polynomial hashes modulo a power of two confuse."""
    for n in (64, 1024, 2048, 4096):
        a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        b = a.translate(str.maketrans("ab", "ba"))
        h, *_ = W.words(*W.utf8(pa.array([a, b])), lower=False)
        assert h[0] != h[1]
        h, _, _, first = W.words(*W.utf8(pa.array([" ".join(a), " ".join(b)])), lower=False)
        for k in (2, 35, n):
            w, at = W.windows(h, first, k)
            assert len({*w}) == len({(a + b)[i : i + k] for i in at})


# -- 1


def test_url_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/a?q#f": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "x://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "x://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://a.com?x=/": ("a.com", "", None, "allow"),
        "http://ÄB.com/é": ("Äb.com", "/é", "com/", "allow"),
        "no url": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    table = spark.createDataFrame([(k, u, None, "clash") for k, u in enumerate(cases)] + [(99, None, None, None), (99, None, "<a href='http://x.org/'>", None)], "page_id int, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(table).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    assert got[99] == ("", "", None, "allow")
    assert urls.judge(table.limit(0)).count() == 0


def dense_ranks(names, edges, seeds):
    """(trust, distrust) of each name as solutions of the linear equations."""
    n = len(names)
    send = np.zeros((n, n))
    for (x, y), count in edges.items():
        send[names.index(x), names.index(y)] += count
    total = send.sum(axis=1)
    send = np.where(total[:, None] > 0, send / np.maximum(total, 1)[:, None], np.eye(n))
    d = urls.DAMPING
    keeps = np.diag(np.diag(send) * (total == 0))
    seed = np.array([seeds.get(x, (0, 0)) for x in names], float)
    trust = np.linalg.solve(np.eye(n) - d * send.T, (1 - d) * seed[:, 0])
    distrust = np.linalg.solve(np.eye(n) - d * np.where(total[:, None] > 0, send, keeps), (1 - d) * seed[:, 1])
    return {x: (t, u) for x, t, u in zip(names, trust, distrust)}


def test_propagation_matches_the_dense_solution(spark):
    names = [f"h{k}" for k in range(14)]
    random.seed(2)
    edges = {(a, b): random.randint(1, 4) for a in names[:9] for b in random.sample(names[:12], 3) if a != b} | {("h12", "h13"): 2, ("h13", "h12"): 1}
    seeds = {n: (float(k % 3 == 0), float(k % 4 == 1)) for k, n in enumerate(names[:10])} | {"h12": (0.5, 0.5)}
    hosts = spark.createDataFrame([(n, *s) for n, s in seeds.items()], "host string, trust_seed double, distrust_seed double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(hosts, spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")).collect()}
    want = dense_ranks(names, edges, seeds)
    assert all(abs(got[n][k] - want[n][k]) < 1e-6 for n in got for k in (0, 1)) and "h13" in got


def test_distrust_blocks_hosts_that_link_to_blocked_ones(spark):
    bad = [(k, f"http://bad.net/es/{k}", "") for k in range(5)]
    rings = [(100 * r + k, f"http://ring{r}.org/{k}", "<A x=1 HREF='http://bad.net/es/1?a=1&amp;b'>b</a><a href=//bad.net/fr/>c</a>") for r in range(1, 31) for k in range(2)]
    mixed = [(7000, "http://mixed.org/", "<a href='http://bad.net/es/1'></a>" + "".join(f"<a href='http://fine{k}.org/'></a>" for k in range(5)))]
    behind = [(7001, "http://behind.org/", "<a href='http://ring1.org/'>x</a>")]
    good = [(20, "http://good.org/", '<a href="/x">x</a>'), (21, "http://popular.org/", "")]
    pages = bad + rings + mixed + behind + good + [(8000, "http://shop.com/", "<a href='http://popular.org/'></a>")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert all(got[k]["verdict"] == "block" and got[k]["rule"] is None for k, *_ in rings)
    assert got[7000]["verdict"] == got[20]["verdict"] == got[21]["verdict"] == "allow" and got[7001]["verdict"] == "block"
    assert abs(got[7000]["distrust"] - 0.85 / 6) < 1e-6 and abs(got[7001]["distrust"] - 0.85**2) < 1e-6 and got[21]["trust"] > 0.8


# -- 2


@pytest.fixture(scope="module")
def word_coder():
    return bpe.Coder(packing.tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, docs, empty, word_library):
    path = packing.tokenizer_path("word_bpe_49k.json")
    want = collections.Counter()
    for d, t, *_ in rows():
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        text = word_library.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.digests(docs, path).collect())) == want
    assert bpe.digests(empty, path).count() == 0
    assert bpe.encoded(docs.select("doc_id", "text"), path).where("text IS NULL").first()["ids"] == []


@pytest.mark.parametrize("text", ["<|endoftext|>a<|startoftext|> b", "it's I'LL Σας ΑΣ", "１２ ½ İ ſ", "\x1c\u2028\u1680x\u180e", "é e\u0301", "ﬁ \ufeff"])
def test_bpe_odd_texts(word_coder, word_library, text):
    assert word_coder.encode(text).tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_bpe_long_words_use_bounded_windows(word_coder, word_library):
    random.seed(4)
    for pieces in (["th", "ing", "er", "an", "s", "tion"], list("abcdeinorst"), ["é", "漢", "ö"], ["a"]):
        text = "".join(random.choice(pieces) for _ in range(6000))
        assert list(word_coder.transduce(text)) == word_library.encode(text, add_special_tokens=False).ids


def test_bpe_stretches_do_not_show(word_coder, word_library, monkeypatch):
    random.seed(14)
    odd = ["it's", "e\u0301", "ΑΣ", "<|endoftext|>", "\u2028", "漢字", "don't  ", "\n", "x" * 700, "\t1 2", "\u0301", " "]
    texts = ["".join(random.choice(odd + [" a", " the"]) for _ in range(300)) for _ in range(6)] + ["y" * 3000 + " z"]
    for stretch in (1, 7, 50):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        monkeypatch.setattr(bpe, "IDS_AT_ONCE", 5)
        for t in texts:
            assert word_coder.encode(t).tolist() == word_library.encode(t, add_special_tokens=False).ids


def test_small_lookahead_is_sufficient():
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("c", "ab"), ("a", "c")]
    ahead = bpe.sufficient_lookahead(merges, "")
    c = bpe.Coder.__new__(bpe.Coder)
    c.rank = {m: k for k, m in enumerate(merges)}
    random.seed(6)
    for _ in range(400):
        text = [random.choice("abc") for _ in range(24)]
        known = c.merge(text[:18])
        whole, at, stable = c.merge(list(text)), 0, []
        for t in known:
            at += len(t)
            if at <= 18 - ahead:
                stable.append(t)
        assert whole[: len(stable)] == stable


def test_decoder_holds_unfinished_characters(word_coder):
    ids = word_coder.encode("naïve 漢字 😀 text")
    machine = bpe.Decoder(word_coder.raw, b"")
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "naïve 漢字 😀 text "
    assert "".join(word_coder.decoded(ids)) == " ".join(word_coder.token[i] for i in ids)


# -- 3 and 10


def fold(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3


def test_quality_separates_and_handles_odd_rows(spark, docs, empty):
    random.seed(8)
    good = [(1000 + k, prose(random.randint(40, 200)).capitalize() + ".") for k in range(300)]
    bad = [(2000 + k, " ".join([random.choice(VOCAB).upper() + "!!"] * random.randint(20, 90))) for k in range(100)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 2000)) for d, _ in good + bad] + [(1000, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    got = quality.score(table, model).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"]) == 1) for r in got) and 0 < len(held) < len(got)
    assert np.mean([r["predicted"] == (r["doc_id"] < 2000) for r in held]) > 0.95
    odd = quality.score(docs, model).collect()
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    assert quality.keep(docs, model).columns == docs.columns
    assert quality.fit(empty, labels) is None and quality.score(docs, None).first()["score"] == 0.5
    assert quality.score(empty, model).count() == 0


def test_quality_labels_of_held_out_rows_are_not_used(spark):
    random.seed(9)
    table = spark.createDataFrame([(k, prose(50) if k % 2 else prose(50).upper()) for k in range(120)], "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(k, (k % 2) ^ (flip and fold(k) == 1)) for k in range(120)], "doc_id long, quality int")
    a, b = quality.fit(table, label(False)), quality.fit(table, label(True))
    assert np.allclose(a.means, b.means) and np.allclose(a.factors, b.factors) and a.shift == b.shift


def test_language(spark, docs, empty):
    random.seed(10)
    stems = {"en": ["the", "and", "ing", "that"], "fr": ["é", "que", "les", "oi"], "de": ["ß", "sch", "der", "ü"]}
    table = [(k, " ".join("".join(random.choices(stems[lang], k=3)) for _ in range(30)), lang) for k, lang in enumerate(list(stems) * 60)]
    df = spark.createDataFrame(table + [(900, "x", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert (model.weights == 0).mean() > 0.3
    truth = {k: lang for k, _, lang in table}
    got = [r for r in language.predict(df, model).collect() if r["doc_id"] in truth]
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    odd = {r["doc_id"]: r for r in language.predict(docs.where("doc_id IS NOT NULL"), model).collect()}
    for d, t, *_ in rows():
        if d is not None:
            assert (odd[d]["lang_pred"] == "und") == (not any(map(str.isalpha, t or ""))) and 0 <= odd[d]["score"] <= 1
    assert language.predict(docs, language.fit(empty)).where("lang_pred <> 'und'").isEmpty()
    assert language.keep(docs, model).columns == docs.columns


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Ab cdé fgh ij" * 9
    whole = language.counts(text)
    monkeypatch.setattr(language, "PIECE", 7)
    assert (language.counts(text) == whole).all()


# -- 4


def test_media_round_trip(spark, docs, empty):
    htmls, payloads = media.stored(docs)
    features = media.media_features(payloads)
    got = collections.defaultdict(list)
    for r in media.resolve(media.sequences(htmls, "doc_id", "html"), "doc_id", features).orderBy("pos").collect():
        got[r["doc_id"]].append(r)
    copies = collections.Counter(d for d, *_ in rows())
    assert features.count() == features.select("digest").distinct().count() and sum(map(len, got.values())) == 5 * len(rows())
    for d, t, *_ in rows():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert media.from_media(media.to_media(payload, len(raw))) == (payload, len(raw))
        if copies[d] == 1:
            head, small, middle, big, end = got[d]
            assert (big["n_bytes"], big["payload_bytes"], big["payload_sha256"], big["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert small["caption"] == "preview" and small["payload_bytes"] == 64 and big["caption"] == f"payload: {len(raw)} bytes"
            assert head["text"] == f"Text of {len(raw)} bytes" and middle["text"] == f"It takes {len(payload) // 64} rows & 64 columns:" and end["text"] == "end of " + big["digest"][:8]
            assert [x["pos"] for x in got[d]] == list(range(5)) and head["n_bytes"] is None
    assert media.stored(empty)[0].count() == media.stored(empty)[1].count() == 0


def test_a_task_stores_equal_payloads_once(spark):
    df = spark.createDataFrame([(k, "same text") for k in range(50)] + [(50, None), (51, "")], "doc_id long, text string").coalesce(1)
    assert media.stored(df)[1].count() == 4


def test_html_items_stay_in_order(spark):
    html = """<p>One <b>two</b></p><script>no<img src=media:no></script>three<figure><img src='media:d1' alt='a'><figcaption>Cap &amp; <i>tion</i></figcaption></figure>
        <img src=media:nope><video title=v><source src='http://x/v.mp4'><source src=w></video><picture><source srcset=s><img data-src='http://x/y.png?a=1&amp;b' alt=z></picture>end<audio src=q></audio><p>"""
    got = [(x["kind"], x["text"], x["tag"], x["source"], x["digest"], x["caption"]) for x in media.parse(html)]
    assert got == [
        ("text", "One two", None, None, None, None),
        ("text", "three", None, None, None, None),
        ("media", None, "img", "media:d1", "d1", "Cap & tion"),
        ("media", None, "img", "media:nope", "nope", None),
        ("media", None, "video", "http://x/v.mp4", None, "v"),
        ("media", None, "img", "http://x/y.png?a=1&b", None, "z"),
        ("text", "end", None, None, None, None),
        ("media", None, "audio", "q", None, None),
    ]
    store = spark.createDataFrame([("d1", 5), ("d2", 6)], "digest string, size int")
    sources = spark.createDataFrame([("http://x/v.mp4", "d2"), ("unused", "d1")], "source string, digest string")
    items = media.sequences(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html")
    rows_ = media.resolve(items, "id", store, sources).orderBy("pos").collect()
    assert [r["pos"] for r in rows_] == list(range(8)) and [r["size"] for r in rows_] == [None, None, 5, None, 6, None, None, None]
    assert [r["source"] for r in media.resolve(items, "id", store).orderBy("pos").collect()][4] == "http://x/v.mp4"


def test_pages_become_sequences(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = media.sequences(pages, "page_id", "html")
    items = got.select("page_id", F.explode("items").alias("i")).select("page_id", "i.*")
    assert got.count() == pages.count() and items.where("kind = 'text'").count() > pages.count()
    assert items.where("kind = 'text' AND (text IS NULL OR text RLIKE '^ | $|  ')").isEmpty()


# -- 5


def repeats_by_brute_force(docs_, window):
    starts = collections.Counter(tuple(w[k : k + window]) for w in docs_ for k in range(len(w) - window + 1))
    for w in docs_:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        yield gone


@pytest.mark.parametrize(("window", "block", "keys"), [(35, 18, 1 << 19), (7, 4, 1 << 19), (3, 2, 1)])
def test_substrings(docs, monkeypatch, window, block, keys):
    monkeypatch.setattr(substring, "MOST_KEYS", keys)
    all_words = [split(t) for _, t, *_ in rows()]
    want = collections.Counter()
    for (d, *_), w, gone in zip(rows(), all_words, repeats_by_brute_force(all_words, window)):
        kept = [x for x, g in zip(w, gone) if not g]
        want[d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    assert collections.Counter(map(tuple, substring.digests(docs, window, block).collect())) == want


def test_substring_texts(spark, docs, empty):
    got = substring.remove(docs)
    assert got.columns == docs.columns and got.count() == len(rows())
    kept = {r["doc_id"]: r for r in got.where("doc_id IS NOT NULL").collect()}
    assert kept[0]["text"] == rows()[0][1] and kept[30]["text"] == "" and kept[30]["n_chars"] == 0
    assert all(SHARED not in (r["text"] or "") for r in kept.values())
    assert substring.remove(empty).count() == 0 and substring.digests(empty).count() == 0
    with pytest.raises(ValueError):
        substring.repeats(docs, 10, 9)


# -- 6


def components_by_brute_force(docs_, k, num, den):
    sets = []
    for d, t, *_ in docs_:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(docs_):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(s), least.get(find(i))) for i, ((d, *_), s) in enumerate(zip(docs_, sets)))


@pytest.mark.parametrize(("k", "num", "keys"), [(4, 85, 1 << 19), (2, 50, 1)])
def test_jaccard(docs, monkeypatch, k, num, keys):
    monkeypatch.setattr(jaccard, "MOST_IDS", keys)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, k, num, 100).collect())
    want = components_by_brute_force(rows(), k, num, 100)
    # Rows without an id and without a set have no component.
    assert got == want


def test_jaccard_in_large_blocks(spark, monkeypatch):
    """Many near copies of one text: blocks of many rows, so that trees and their bounds decide."""
    random.seed(12)
    base = prose(90).split()
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(random.randint(0, 6)):
            w[random.randrange(len(w))] = f"y{random.randrange(10**6)}"
        texts.append(" ".join(w[random.randint(0, 3) :]))
    table = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "frequent", lambda docs, k: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect())
    assert got == components_by_brute_force(table, 4, 85, 100)


def test_best_partners(monkeypatch):
    monkeypatch.setattr(jaccard, "FLUSH", 5)
    random.seed(3)
    value = {(i, j): random.random() for j in range(12) for i in range(j) if random.random() < 0.7}
    pairs = [(np.array([i]), np.array([j]), np.array([v])) for (i, j), v in value.items()]
    *found, cut = (x.tolist() for x in jaccard.most_similar(iter(pairs), 2))
    got = set(zip(*found))
    assert {k for k in range(12) if sum(k in p for p in value) > 2} <= set(cut) and all(sum(k in p for p in value) > 2 for k in cut)
    of = lambda k: sorted((p for p in value if k in p), key=value.get)[-2:]
    assert {p for k in range(12) for p in of(k)} <= got <= set(value)
    assert [len(x) for x in jaccard.most_similar(iter([]), 2)] == [0, 0, 0]


def test_keep_one(docs, empty):
    kept = jaccard.keep_one(docs, 5, 80, 100)
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    # The null-id copy of text 30 goes like any other copy, the null-id row without a text stays.
    assert kept.columns == docs.columns and max(n for d, n in ids.items() if d is not None) == 1 and ids[None] == 1
    assert 30 in ids and 31 not in ids and 32 not in ids and 33 not in ids and jaccard.keep_one(empty).count() == 0


def test_blocks_with_the_same_sets_are_kept_once(spark):
    sets = [(0, 20, [1, 2, 3, 9]), (1, 20, [1, 2, 3, 8]), (2, 20, [2, 4, 5, 6])]
    rows = jaccard._blocks(spark.createDataFrame(sets, "rep long, n long, prefix array<long>"), 85, 100)
    assert sorted((r["token"], r["rep"], r["pos"]) for r in rows.collect()) == [(1, 0, 0), (1, 1, 0), (2, 0, 1), (2, 1, 1), (2, 2, 0)]
    rows = jaccard._blocks(spark.createDataFrame(sets[:2], "rep long, n long, prefix array<long>"), 85, 100)
    assert sorted((r["token"], r["rep"], r["pos"]) for r in rows.collect()) == [(1, 0, 0), (1, 1, 0)]


def test_jaccard_thresholds(docs):
    for num in (49, 101):
        with pytest.raises(ValueError):
            jaccard.join(docs, 4, num, 100)


def bridge():
    """Texts of which the first and the last are linked only through the middle one."""
    w = [f"w{k}" for k in range(107)]
    return " ".join(w[:100]), " ".join(w[3:103]), " ".join(w[6:106])


def test_jaccard_links_through_rows_without_an_id(spark):
    a, b, c = bridge()
    table = [(1, a), (None, b), (2, c), (None, "alone with words"), (None, None)]
    got = collections.Counter(map(tuple, jaccard.join(spark.createDataFrame(table, "doc_id long, text string"), 4, 90, 100).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == components_by_brute_force(table, 4, 90, 100) and got[2, 97, 1] == 1 and got[None, 97, 1] == 1


def test_jaccard_with_one_id_for_two_texts(spark):
    one, two = prose(90), prose(90)
    near = two + " ended otherwise"
    df = spark.createDataFrame([(1, one), (1, two), (3, near), (3, near)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.join(df).select("doc_id", "component_id").collect()))
    assert got == [(1, 1), (1, 1), (3, 1), (3, 1)]
    kept = jaccard.keep_one(df)
    assert sorted(r["text"] for r in kept.collect()) == sorted([one, two])


@pytest.mark.parametrize(("chunk", "fanout"), [(1024, 4), (16, 2), (7, 8)])
def test_trees_give_all_pairs_of_a_block(monkeypatch, chunk, fanout):
    """Of sets with a common token, dealt into chunks, every linked pair comes from a tree."""
    random.seed(5)
    monkeypatch.setattr(jaccard, "FANOUT", fanout)
    sets = []
    for _ in range(12):
        base = np.array(random.sample(range(1 << 40), random.randint(33, 60)), np.uint64)
        for _ in range(random.randint(1, 9)):
            s = base.copy()
            s[: random.randint(0, 6)] = np.array(random.sample(range(1 << 40), 60), np.uint64)[: 60][0]
            sets.append(np.unique(W.mix(s)))
    band, words = 5, jaccard.width(5, jaccard.FINE) // 64
    sets = [s for s in sets if 32 <= len(s) < 64]
    n, want = len(sets), set()
    for i in range(n):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                want.add((j, i))
    of = [k % (1 + n // chunk) for k in range(n)]
    rows_ = [(x * 100 + y, k, len(sets[k]), len(sets[k]), k, int(of[k] != x), True, x != y, words, 7, jaccard.bitmap(sets[k], jaccard.FINE)) for x in set(of) for y in set(of) if x <= y for k in range(n) if of[k] in (x, y)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows_)], ["block", "rep", "n", "room", "comp", "side", "home", "split", "words", "key", "bits"])
    got = [tuple(p) for b in jaccard._tree_pairs(85, 100, None)(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert want <= set(got) and len(want) > 20 and len(got) < n * (n - 1) // 4


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[k] for k in [*range(51), 300]} == {0} and {got[k] for k in range(100, 140)} == {100} and 200 not in got


# -- 7


def test_packing(docs, empty):
    encode = packing.encoder(packing.tokenizer_path("byte_bpe_50k.tiktoken"), packing.tokenizer_path("byte_bpe_50k.json"))
    got = packing.packed(docs).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    copies = collections.Counter(d for d, *_ in rows())
    for d, t, *_ in rows():
        ids = [*encode(t or "").tolist(), 2]
        want = [(s, min(1024, len(ids) - s) if s else (len(ids) % 1024 or min(1024, len(ids)))) for s in ([0] + list(range(len(ids) % 1024 or 1024, len(ids), 1024)))]
        if d is not None and copies[d] == 1:
            pieces = sorted(by_doc[d], key=lambda r: r["piece"])
            assert [(r["start"], r["length"]) for r in pieces] == want and [r["piece"] for r in pieces] == list(range(len(want)))
            assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in pieces)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 1024) + 1
    assert packing.packed(empty).count() == 0


def test_byte_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    encode = packing.encoder(packing.tokenizer_path("byte_bpe_50k.tiktoken"), packing.tokenizer_path("byte_bpe_50k.json"))
    for t in [x[1] or "" for x in rows()] + ["<|endoftext|> a<|endoftext|>", "  \n\n x ", "I'll they've", " " * 1_200_000]:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_pack_rule():
    sequence, offset, n = packing.pack(np.array([6, 6, 4, 4, 3, 1]), 10)
    assert n == 3 and [list(sequence).count(k) for k in range(3)] == [2, 2, 2]
    # One sequence with gap 4, two with gap 3, a piece of 1: closing nothing, it leaves the most crowded gap.
    sequence, offset, n = packing.pack(np.array([7, 7, 6, 1]), 10)
    assert offset[3] == 7


# -- 8


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    table = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[0].tolist()) for k in range(40)]
    odd = [(2000, None), (2010, []), (2020, [0.0] * 8), (2030, [float("nan")] + [1.0] * 7), (2040, [None] + [1.0] * 7), (2050, [1.0] * 3), (None, x[1].tolist()), (2060, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in table + odd], "vec_id long, embedding array<float>, node string")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, "vec_id", "embedding", F.pmod(F.col("id"), F.lit(10)) == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, v = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    hits = total = 0
    assert set(got) == {int(i) for i in ids if i % 10 == 0}
    for q, found in got.items():
        s = u @ u[list(ids).index(q)]
        order = [k for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != q][:5]
        hits += len({int(ids[k]) for k in order} & {i for i, _ in found})
        total += 5
        assert len(found) == 5 and all(abs(s[list(ids).index(i)] - c) < 1e-12 for i, c in found)
    assert hits / total >= 0.95
    assert [i for i, _ in got[0]] == [1000, 1001, 1002, 1003, 1004] and [i for i, _ in got[1000]] == [0, 1001, 1002, 1003, 1004]


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    one = F.col("id") == 0
    assert [tuple(r) for r in neighbours.nearest(df, "vec_id", "embedding", one).collect()] == [(0, 1, 1, 0.0)]
    assert neighbours.nearest(df.limit(0), "vec_id", "embedding", one).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), "vec_id", "embedding", one).count() == 0


def test_neighbours_of_huge_and_tiny_vectors(spark):
    x = [[1e200, 1e200], [1e200, 0.9e200], [1e-300, 1e-300], [-1e200, 3e-200], [1.0, 0.0]]
    got = neighbours.nearest(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") == 0).collect()
    score = {r["vec_id"]: r["score"] for r in got}
    assert [r["vec_id"] for r in got][:2] == [2, 1] and abs(score[2] - 1) < 1e-15 and abs(score[4] - 0.5**0.5) < 1e-15 and score[3] < -0.7


def test_queries_that_the_search_leaves_short_are_scanned(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SCANNED", 3)
    x = np.random.default_rng(4).standard_normal((60, 6))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    nodes = neighbours.saved(neighbours.nodes_of(neighbours.usable(df, "vec_id", "embedding"), 5), "nodes")
    queries = nodes.select(F.col("ids")[0].alias("id"), "node").where("id % 6 = 0")
    none = spark.createDataFrame([(0, 1, 7, 0.5)], "query_id long, rank int, vec_id long, score double")
    got = collections.defaultdict(list)
    for r in neighbours.completed(none, nodes, queries, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    s = neighbours.unit(x) @ neighbours.unit(x).T
    np.fill_diagonal(s, -2)
    assert got == {q: np.argsort(-s[q])[:5].tolist() for q in range(0, 60, 6)}


def test_recall_over_many_cells(spark):
    """20,000 vectors without clusters, with the parameters of production: more than a hundred cells, so descent decides."""
    x = np.random.default_rng(7).standard_normal((20_000, 32)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))})).repartition(4)
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df, "vec_id", "embedding", F.pmod(F.col("id"), F.lit(50)) == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    u = neighbours.unit(x.astype(float))
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        hits += len(found & set(np.argpartition(-s, 5)[:5].tolist()))
    assert len(got) == 400 and hits / (5 * len(got)) >= 0.9


def test_neighbour_graph_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    x = np.random.default_rng(1).standard_normal((1200, 24))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, vector array<double>")
    nodes = neighbours.saved(neighbours.nodes_of(neighbours.usable(df, "id", "vector"), 5), "nodes")
    of = {r["node"]: r["ids"][0] for r in nodes.select("node", "ids").collect()}
    graph = {of[r["node"]]: [of[x] for x in np.frombuffer(r["neighbours"], np.int64)[:5]] for r in neighbours.graph_of(nodes, k=10, trees=2).collect()}
    u = neighbours.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :5]
    assert sorted(graph) == list(range(1200))
    assert sum(len(set(true[k]) & set(graph[k])) for k in graph) / true.size >= 0.9


# -- 9


def test_chat_reads_back(spark):
    odd = ["\\", "\\b\\l\\i", "<|im_end|>\n", "<|im_start|>user\nx", "[INST] [/INST] <s></s> <<SYS>><</SYS>>", "<|im_", "end|>\n", "", None, "plain " * 400, "\n\n"]
    turns = [(1, 0, "system", "be\nnice", 0)] + [(1, k + 1, ["user", "assistant", None, "to\\ol\n"][k % 4], t, 0) for k, t in enumerate(odd * 2)]
    turns += [(2, 0, "assistant", "alone", 0), (None, None, "user", "z", 0), (3, 1, "user", "tie", 0), (3, 1, "assistant", "tie", 0), (3, 1, "assistant", "tie", 0), (4, 0, "system", None, 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, span int")
    w = chat.windows(df, 40, 30)
    back = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    for c in {t[0] for t in turns}:
        own = sorted([(t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == c])
        assert [tuple(t) for t in back[c]["turns"]] == [(r, x) for _, r, x in own]
        assert back[c]["losses"] == [x for _, r, x in own if r == "assistant"]
    spans = w.where("conv_id = 1").orderBy("span").collect()
    assert len(spans) > 2 and all(s["formatted"].startswith("<|im_start|>system\nbe\nnice<|im_end|>\n") for s in spans)
    assert spans[0]["n_repeated"] == 0 and all(s["n_repeated"] >= 1 for s in spans[1:])
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_is_native(spark, sf_dir):
    plan = chat.op9_chat_formatting(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- pipeline and registry


def test_pipeline_stages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = table
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, sf_dir)
        assert after.columns == table.columns and after.dtypes == table.dtypes
        got = {r["doc_id"]: r["text"] for r in after.collect()}
        given = {r["doc_id"]: r["text"] for r in before.collect()}
        assert got.keys() <= given.keys()
        if name == "n-gram Jaccard join":
            groups = components_by_brute_force(list(given.items()), 5, 80, 100)
            assert got.keys() == {d for d, _, c in groups if d == c}
        if name == "substring dedup":
            want = dict(zip(given, repeats_by_brute_force([split(t) for t in given.values()], 35)))
            assert all(split(got[d]) == [w for w, g in zip(split(given[d]), gone) if not g] for d, gone in want.items())
        before = spark.createDataFrame(after.collect(), table.schema)
    last = corpus_pipeline.STAGES[4][1](spark, before, sf_dir)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.collect()}


def test_all_operators_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_chat_oracle(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = c.execute(chat.ORACLE).df()
    got = chat.op9_chat_formatting(spark, sf_dir).toPandas()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].itertuples(index=False)))
    assert json.dumps(key(got), default=str) == json.dumps(key(want), default=str)
