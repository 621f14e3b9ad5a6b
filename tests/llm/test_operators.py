"""Each operator on small tables: nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash

from trajecta.llm import doc_sketch, html_extract, language_id, mixing, near_copies, neighbours, secret_scan, sentencepiece_bpe, sharding, simhash, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, vocabulary="the of and to in is that for it was on with as be at by this from or".split()):
    return " ".join(r.choice(vocabulary) + r.choice(["", "", "ing", "ed", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    rows = [(i, words(r, r.randint(1, 80)), "en" if i % 2 else "fr", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[4][1], "en", "s0", 0), (100, rows[4][1], "en", "s0", 0), (None, "some words of a row without id", "en", "s1", 0), (101, None, "en", "s1", 0), (102, "", None, None, None), (103, " \n\t ", "en", "s2", 0), (104, words(r, 20_000), "fr", "s2", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- URL filter


def test_url_rules(spark):
    urls = ["https://www.Example.com/en/1", "http://example.com/en/2?x", "http://example.com/fr", "http://a.net/es/", "http://a.net/en/", "http://net/fr/x#y", "http://com", "no scheme", None, "", "x://y://z.com/", "http://notexample.com/en/", "http://example.com:80/en/"]
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)] + [(None, urls[1], "kept"), (1, urls[1], "kept")], "page_id long, url string, Verdict string")
    out = rows(url_filter.filter_urls(df, url_filter.rule_table(spark, url_filter.RULES)))
    assert len(out) == len(urls) + 2 and set(out[0]) == {"page_id", "url", "host", "path", "rule", "verdict"}
    by = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert by[urls[0]] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[urls[1]] == ("example.com", "/en/2", "example.com/en/", "block")
    assert by[urls[2]] == ("example.com", "/fr", "com/", "allow")
    assert by[urls[3]][2:] == ("net/es/", "block") and by[urls[4]][2:] == (None, "allow") and by[urls[5]][2:] == ("net/fr/", "block")
    assert by[urls[6]] == ("com", "", None, "allow") and by["no scheme"] == by[None] == by[""] == ("", "", None, "allow")
    assert by["x://y://z.com/"] == ("y:", "//z.com/", None, "allow") and by[urls[11]][2] == "com/" and by[urls[12]] == ("example.com:80", "/en/", None, "allow")


def test_url_filter_is_exact_for_any_filter_size(spark):
    r = random.Random(1)
    hosts = [f"{r.choice('abc')}{r.randint(0, 40)}.{r.choice(('com', 'net'))}" for _ in range(300)]
    rules = {(h, f"/{r.randint(0, 3)}/") for h in hosts[:80]}
    urls = [f"http://{r.choice(('', 'x.', 'y.z.'))}{r.choice(hosts)}/{r.randint(0, 5)}/{i}" for i in range(400)]
    table = url_filter.rule_table(spark, tuple(("block", h + p) for h, p in sorted(rules)))
    for size in (32, 1 << 20):  # one block lets nearly everything through
        out = url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), table, max_filter_bytes=size)
        for x in rows(out):
            fit = [h + p for h, p in rules if (x["host"] == h or x["host"].endswith("." + h)) and x["path"].startswith(p)]
            assert x["rule"] == (max(fit, key=len) if fit else None) and x["verdict"] == ("block" if fit else "allow")


def test_url_filter_empty(spark):
    none = url_filter.rule_table(spark, ())
    some = spark.createDataFrame([("http://a.com/",)], "url string")
    assert rows(url_filter.filter_urls(some, none))[0]["verdict"] == "allow"
    assert rows(url_filter.filter_urls(some.limit(0), url_filter.rule_table(spark, url_filter.RULES))) == []


# --- nearest neighbours


def test_neighbours_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 16)).astype(np.float32)
    x[50:90] = x[7]
    table = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    table += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (None, table[0][1]), (9004, [1.0]), table[3], (9005, [])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    neighbours.HOME, before = 256, neighbours.HOME  # several homes
    try:
        out = rows(neighbours.nearest_neighbours(df, neighbours.F.expr("vec_id % 50 = 0 or vec_id = 7")))
    finally:
        neighbours.HOME = before
    assert {o["vec_id"] for o in out} <= set(range(3000)) and len(out) == 10 * 61
    hit = 0
    for q in {o["query_id"] for o in out}:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        got = sorted((o for o in out if o["query_id"] == q), key=lambda o: o["rank"])
        assert [o["rank"] for o in got] == list(range(1, 11)) and all(abs(o["score"] - d[o["vec_id"]]) < 1e-9 for o in got)
        hit += len({o["vec_id"] for o in got} & set(want.tolist()))
        if q in (7, 50):
            assert [o["vec_id"] for o in got] == want.tolist()
    assert hit >= 0.9 * len(out)


def test_neighbours_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    out = rows(neighbours.nearest_neighbours(df, neighbours.F.expr("vec_id % 100 = 0")))
    assert [(o["rank"], o["vec_id"], round(o["score"], 6)) for o in sorted(out, key=lambda o: o["rank"])] == [(1, 1, 1.414214), (2, 2, 1.414214)]
    assert rows(neighbours.nearest_neighbours(df.limit(0), neighbours.F.expr("true"))) == []


# --- sharding


def test_shards_are_even_and_gapless(docs):
    out = rows(sharding.shard_rows(docs.withColumn("Shard", docs.lang), n_shards=7))
    assert len(out) == docs.count() and "Shard" not in out[0] and "lang" in out[0]
    by = {}
    for x in out:
        by.setdefault(x["shard"], []).append(x["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    for x in out:
        raw = (texts[x["doc_id"]] or "").encode()
        assert x["size"] == len(raw) + 16 and x["text_crc32"] == zlib.crc32(raw) and x["law"] == "rows" and x["grown_shard"] is None


def test_ring_keeps_most_rows_when_it_grows():
    r = random.Random(0)
    counts = {}
    for _ in range(20_000):
        counts.setdefault(r.randrange(sharding.RING), 0)
        counts[r.randrange(sharding.RING)] = counts.get(r.randrange(sharding.RING), 0) + 1

    def homes(n, epsilon):
        out = {}
        for slot, a, b, shard, _ in sharding.place(counts, n, epsilon):
            out.update({(slot, i): shard for i in range(a, b)})
        return out

    a, b = homes(10, 0.25), homes(11, 0.25)
    assert len(a) == sum(counts.values()) and max(np.bincount(list(a.values()))) <= math.ceil(1.25 * len(a) / 10)
    assert sum(a[k] != b[k] for k in a) < 0.45 * len(a)  # a modulus would move 10 of 11


def test_shards_of_nothing(empty):
    assert rows(sharding.shard_rows(empty)) == []


# --- SimHash


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components(fps, near):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if near(fps[i], fps[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark, docs):
    r = random.Random(4)
    base = words(r, 300).split()
    more = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(300)] = words(r, 1)
        more.append((200 + i, " ".join(w), "en", "s", 0))
    df = docs.where("doc_id is not null").unionByName(spark.createDataFrame(more, DOCS)).withColumn("Fingerprint", docs.lang)
    out = rows(simhash.simhash_duplicates(df.select("doc_id", "text", "Fingerprint")))
    texts = [(r["doc_id"], r["text"]) for r in rows(df)]
    fps = {k: brute_fingerprint(t) for k, t in texts}
    assert len(out) == len(texts) and all(int(o["fingerprint"], 16) == fps[o["doc_id"]] and len(o["fingerprint"]) == 16 for o in out)
    keys = sorted(fps)
    found = components([fps[k] for k in keys], lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for k, c in zip(keys, found, strict=True):
        least[c] = min(least.get(c, k), k)
    want = {k: least[c] for k, c in zip(keys, found, strict=True)}
    assert {o["doc_id"]: o["component_id"] for o in out} == want and len(set(want.values())) < len(want) - 5


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    r = random.Random(5)
    near = [0]
    for _ in range(120):
        near.append(r.choice(near) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    near += [r.getrandbits(64) for _ in range(60)]
    signed = [v - (1 << 64) if v >> 63 else v for v in near]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, __fp long")
    got = {o["doc_id"]: o["component_id"] for o in rows(simhash.near_duplicates(df))}
    found = components(near, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {c: found.index(c) for c in found}
    assert got == {i: least[c] for i, c in enumerate(found)}


def test_simhash_of_nothing(empty):
    assert rows(simhash.simhash_duplicates(empty.select("doc_id", "text"))) == []


def test_near_copies_against_brute_force(spark, docs):
    r = random.Random(6)
    more = []
    for k in range(8):
        base = words(r, 200, [f"w{r.randrange(5000)}" for _ in range(400)]).split()
        for i in range(5):
            w = list(base)
            for _ in range(i):
                w[r.randrange(200)] = "changed"
            more.append((1000 + 10 * k + i, " ".join(w), "en", "s", 0))
    df = docs.unionByName(spark.createDataFrame(more, DOCS))
    got = {(o["doc_id"], o["component_id"]) for o in rows(near_copies.near_copies(df))}
    pairs = sorted({(r["doc_id"], r["text"] or "") for r in rows(df) if r["doc_id"] is not None})
    sets = [set(near_copies.shingles(t).tolist()) for _, t in pairs]
    found = components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    least = {}
    for (k, _), c in zip(pairs, found, strict=True):
        least[c] = min(least.get(c, k), k)
    assert got == {(k, least[c]) for (k, _), c in zip(pairs, found, strict=True)}


def brute_near_copies(df):
    pairs = sorted({(r["doc_id"], r["text"] or "") for r in rows(df) if r["doc_id"] is not None})
    sets = [set(near_copies.shingles(t).tolist()) for _, t in pairs]
    found = components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9)
    least = {}
    for (k, _), c in zip(pairs, found, strict=True):
        least[c] = min(least.get(c, k), k)
    return {(k, least[c]) for (k, _), c in zip(pairs, found, strict=True)}


def test_near_copies_with_blocks_of_text(spark):
    r, made = random.Random(16), []
    footer = [f"f{k}" for k in range(12)]
    for k in range(30):
        base = [f"w{r.randrange(50_000)}" for _ in range(r.randint(60, 400))]
        n = len(base)
        versions = [base, base[: n * 82 // 100], base + [f"x{r.randrange(50_000)}" for _ in range(n * 22 // 100)], base[n // 6 :]]
        made += [(10 * k + i, " ".join(v + footer * (k % 2)), "en", "s", 0) for i, v in enumerate(versions)]
    df = spark.createDataFrame(made, DOCS)
    want = brute_near_copies(df)
    assert len({c for _, c in want}) < 60 and {(o["doc_id"], o["component_id"]) for o in rows(near_copies.near_copies(df))} == want


# --- language ID


def test_languages_are_told_apart(spark):
    r = random.Random(7)
    made = {"xx": "ka lo mi ne ru ta".split(), "yy": "sch ung ein der ost ich".split(), "zz": "qu oi eau ent les ai".split()}
    docs = [(i, " ".join("".join(r.choice(made[k]) for _ in range(3)) for _ in range(r.randint(5, 60))), k) for i in range(240) for k in [r.choice(list(made))]]
    docs += [(900, None, "xx"), (901, "", "yy"), (902, "12 34 !?", "zz"), (None, docs[0][1], docs[0][2]), (903, docs[0][1], None), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("Score", language_id.F.lit("x"))
    names, prototypes = language_id.fit(df)
    assert names == ["xx", "yy", "zz"]
    out = rows(language_id.identify(df, names, prototypes))
    assert len(out) == len(docs) and all(o["lang_pred"] == "und" and o["score"] == 0 for o in out if o["doc_id"] in (900, 901, 902))
    tested = [o for o in out if o["doc_id"] is not None and o["doc_id"] < 900]
    assert sum(o["lang"] == o["lang_pred"] for o in tested) >= 0.97 * len(tested) and all(0 <= o["score"] <= 1 for o in out)


def test_profile_is_the_sum_of_bound_letters():
    text = "Ab, cÉ"
    codes = [0, *map(ord, "ab"), 0, *map(ord, "cé"), 0]
    v = language_id.letter_vector
    want = sum(np.roll(v(a), 2).astype(int) * np.roll(v(b), 1) * v(c) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    assert (language_id.profiles(["", text, None or ""])[1] == want).all()


def test_languages_of_nothing(empty, docs):
    names, prototypes = language_id.fit(empty)
    assert names == [] and {o["lang_pred"] for o in rows(language_id.identify(docs, names, prototypes))} == {"und"} and rows(language_id.identify(empty, names, prototypes)) == []


# --- HTML


def test_main_text_of_layouts():
    m = html_extract.default_model()
    junk = '<nav class=menu><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>'
    end = '<div class="comments"><h3>Comments</h3><div class="comment"><p>I like this very much.</p></div></div><aside class="sidebar"><a href="/c">More news</a></aside><footer>&copy; 2024 Someone</footer>'
    main = "<h1>A title &amp; more</h1><p>First   paragraph\n with <b>bold</b> text, and <a href=x>a link</a>.<p>Second paragraph is here. It has two sentences.<br>And a line."
    want = "A title & more First paragraph with bold text, and a link. Second paragraph is here. It has two sentences. And a line."
    for a, b in (("<article>", "</article>"), ('<div class="post-content">', "</div>"), ("<main>", "</main>")):
        assert m.extract(f"<html><head><title>T</title><script>var x='</p>';</script></head><body>{junk}{a}{main}{b}{end}</body></html>") == want
    assert m.extract("") == "" and m.extract("<p") is not None and m.extract("<<>><//>&#xZ;") is not None


def test_message_passing_is_exact():
    m = html_extract.default_model()
    nodes = html_extract.parse("<body><div class=ad>x y</div><article><p>One two three.</p></article></body>")
    for n in nodes:
        if n.text is not None:
            n.sign = html_extract._text_sign(n, " ".join("".join(n.text).split()))
    got, total, on = m.marginals(nodes), 0.0, [0.0] * len(nodes)
    for mask in range(1 << (len(nodes) - 1)):
        y, weight = [0] + [mask >> i & 1 for i in range(len(nodes) - 1)], 1.0
        for i, n in enumerate(nodes[1:], 1):
            weight *= m.step["text" if n.text is not None else "block"][y[n.parent]][y[i]] * (m.odds(n.sign, nodes[n.parent].tag) if y[i] else 1)
        total += weight
        on = [o + weight * v for o, v in zip(on, y, strict=True)]
    assert np.allclose(got, [o / total for o in on])


def test_held_out_labelled_pages():
    m, right, total = html_extract.default_model(), 0, 0
    for page in html_extract.labelled_pages(60, seed=77):
        labels, nodes = [], html_extract.parse(page)
        for n in nodes:
            labels.append((labels[n.parent] if n.parent >= 0 else 0) if n.label is None else int(n.label))
        shown = html_extract.parse(re.sub(r' data-main="?[01]"?', "", page))
        for n in shown:
            if n.text is not None:
                text = " ".join("".join(n.text).split())
                n.sign = html_extract._text_sign(n, text) if text else ()
        p = m.marginals(shown)
        for i, n in enumerate(shown):
            if n.text is not None and n.sign:
                total += 1
                right += (p[i] > 0.5) == bool(labels[i])
    assert right >= 0.95 * total


def test_pages_with_nulls(spark):
    long = "<div>" * 3000 + "<p>Deep text is here.</p>"
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", long, "x"), (1, "u", None, "x")], "page_id long, url string, html string, N_CHARS string")
    out = rows(html_extract.extract_pages(df, html_extract.default_model()))
    assert len(out) == 4 and all(o["n_chars"] == len(o["text"]) for o in out) and sum(o["text"] == "" for o in out) >= 3
    assert rows(html_extract.extract_pages(df.limit(0), html_extract.default_model())) == []


# --- document sketches


def test_versions_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(doc_sketch, "ROWS_A_BUCKET", 5)
    out = rows(doc_sketch.compare_versions(docs))
    table = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in rows(docs)), key=lambda x: x[:2])
    assert len(out) == len(table)
    texts = [t for _, _, t in table]
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert sorted(o["edited_sha256"] for o in out) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edited)

    def like(a, b):
        x, y = set(doc_sketch.digests(a).tolist()), set(doc_sketch.digests(b).tolist())
        return len(x & y) / len(x | y) if x | y else 1.0

    want = sorted((round(like(t, e), 12), round(like(t, u), 12), len(t)) for t, e, u in zip(texts, edited, texts[1:] + texts[:1], strict=True))
    assert sorted((round(o["near_edited"], 12), round(o["near_next"], 12), o["n_chars"]) for o in out) == want
    by = {}
    for o in out:
        by.setdefault(o["fingerprint"], set()).add(o["n_chars"])
    assert len({o["fingerprint"] for o in out if o["doc_id"] == 100}) == 1 and all(len(v) == 1 for f, v in by.items() if len(v) > 2)


def test_peeling_recovers_the_difference():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    b = np.concatenate([a[:4990], r.integers(0, 1 << 63, 7, dtype=np.uint64)])
    assert doc_sketch.likeness([a, a, a[:0]], [b, a, a[:0]]).tolist() == [4990 / 5007, 1.0, 1.0]


def test_versions_of_one_and_none(spark, empty):
    one = rows(doc_sketch.compare_versions(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")))
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and rows(doc_sketch.compare_versions(empty)) == []


# --- SentencePiece


def test_pieces_match_the_library(spark, docs):
    path = sentencepiece_bpe.default_model_path()
    lib, proto = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.read_model(spark, path)
    model = sentencepiece_bpe.PieceBPE(proto)
    r = random.Random(8)
    texts = ["", " ", "   ", "a", "\n", "\n\n a\n", "▁", "a▁b", "<s>", "<0x0A>", "x" * 3000, "ab" * 20_000, "é́ ﬁ \u0000 \ufeff 漢字 😀", "well-known (e.g.) 'quoted', \"text\"... 12,345.67%", " lead and trail "]
    texts += ["".join(r.choice(" abcdetinrsoh\n\t.,019AéßŁ▁漢😀_-=/()%$#&") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(r.choice(list(model.ids)) for _ in range(6)) for _ in range(500)]
    for t in texts:
        want = lib.encode(t)
        n, ids, decoded = model.digest(t)
        assert model.encode(t) == want and n == len(want) and ids == ",".join(map(str, want)) and decoded == lib.decode(want) == model.decode(want)
    out = rows(sentencepiece_bpe.encode_pieces(docs.withColumn("N_tokens", docs.lang), proto))
    assert len(out) == docs.count()
    by = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    for o in out:
        ids = lib.encode(by[o["doc_id"]])
        assert (o["n_tokens"], o["ids_sha256"], o["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert rows(sentencepiece_bpe.encode_pieces(docs.limit(0), proto)) == []


def test_ids_and_text_as_columns(spark):
    proto = sentencepiece_bpe.read_model(spark, sentencepiece_bpe.default_model_path())
    out = rows(sentencepiece_bpe.encode_pieces(spark.createDataFrame([("hello\nworld",), (None,)], "text string"), proto, digests=False))
    assert {o["decoded"] for o in out} == {"hello\nworld", ""} and all(len(o["ids"]) == o["n_tokens"] for o in out)


# --- secrets


def brute_secrets(text):
    out = []
    kinds = [(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 1), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0)]
    for k, (p, least, g) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return sorted(out)


def test_secrets_against_brute_force(spark):
    key, live = "AKIA" + "Q7" * 8, "Zx9kQw3eRt5_yUi7oPa1sDf"
    texts = [f"é Password = '{'k' * 12}' {key}", f"token:short secret=token={'a1' * 8} x", "API_KEY: " + "f" * 40, f"copy {key}", f"copy {key} again", f"mine {live} here", None, "", "AKIAAKIA" + "A" * 9 + " ABCDEF0123456789abcdef0123456789", "ſecret=abcdefghijklmnop apikey=\"abcdefabcdefabcdef\""]
    df = spark.createDataFrame([(i, t, f"s{i}", "x") for i, t in enumerate(texts)] + [(None, texts[0], None, "x"), (0, texts[0], "s0", "x")], "doc_id long, text string, source string, Spans string")
    out = rows(secret_scan.find_secrets(df))
    assert len(out) == len(texts) + 2
    by = {o["doc_id"]: o for o in out}
    for i, t in enumerate(texts):
        found = brute_secrets(t)
        assert [by[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(f[1] == k for f in found) for k in range(3)]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
        assert by[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert "generic" in by[5]["spans"] and by[5]["n_live"] == 1 and by[4]["n_shared"] == 1 and by[4]["n_live"] == 0
    clean = rows(secret_scan.redact_live(df.select("doc_id", "text", "source")))
    assert len(clean) == len(out) and [c["text"] for c in clean if c["doc_id"] == 5] == ["mine [SECRET] here"] and [c["text"] for c in clean if c["doc_id"] == 3] == [texts[3]]
    assert rows(secret_scan.find_secrets(df.limit(0))) == []


def test_a_value_of_one_owner_is_live_in_any_number_of_documents(spark):
    mine, copied = "Zx9kQw3eRt5_yUi7oPa1sDf", "AKIA" + "Q7" * 8
    made = [(i, f"mine {mine} {i}", "a") for i in range(200)] + [(1000 + i, f"copy {copied} {i}", f"s{i}") for i in range(3)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    out = rows(secret_scan.find_secrets(df))
    assert all((o["n_live"], o["n_shared"]) == ((1, 0) if o["doc_id"] < 1000 else (0, 1)) for o in out) and all("generic" in o["spans"] for o in out if o["doc_id"] < 1000)
    assert all((mine in c["text"], copied in c["text"]) == (False, c["doc_id"] >= 1000) for c in rows(secret_scan.redact_live(df)))


# --- mixing


def test_mix_hits_its_targets(spark):
    r = random.Random(9)
    rows_in = [(i, s, r.randint(0, 400)) for i in range(2000) for s in [r.choice(["a", "b", "c", "Z", None, "é"])]] + [(None, "a", None), (None, "a", 30), (None, "a", 30), (5000, "tiny", 10)]
    out = rows(mixing.mix(spark.createDataFrame(rows_in, "doc_id long, source string, size long")))
    again = rows(mixing.mix(spark.createDataFrame(rows_in[::-1], "doc_id long, source string, size long")))
    order = lambda o: (o["doc_id"] is None, o["doc_id"] or 0, str(o["source"]), o["size"], o["taken"])
    assert len(out) == len(rows_in) and sorted(out, key=order) == sorted(again, key=order)
    total, size = sum(o["size"] for o in out), {}
    for o in out:
        size[o["source"]] = size.get(o["source"], 0) + o["size"]
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        share = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and share * weight[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        want = 3 * size[s] if s in full else share * weight[s]
        mine = [o for o in out if o["source"] == s]
        assert all(abs(o["target"] - want) < 1e-6 * max(1, want) and o["source_size"] == size[s] for o in mine)
        assert abs(sum(o["taken"] for o in mine) - want) <= 30 and all(o["taken"] <= 3 * o["size"] for o in mine)


def test_mix_lands_each_source_whatever_the_others_size(spark):
    r = random.Random(11)
    made = [(i, "a", r.randint(100, 900)) for i in range(1000)] + [(2000, "a", 60_000)]
    made += [(10_000 + i, "b", r.randint(100, 900)) for i in range(9000)] + [(30_000, "b", 60_000), (30_001, "b", 40_000)]
    got = {}
    for o in rows(mixing.mix(spark.createDataFrame(made, "doc_id long, source string, size long"), (9, 10))):
        off, target = got.get(o["source"], (0, 0))
        got[o["source"]] = (off + o["taken"], o["target"])
    assert all(abs(taken - target) <= 2 for taken, target in got.values()), got


def test_flight_keeps_both_totals():
    r = random.Random(10)
    sizes, p = [float(r.randint(1, 900)) for _ in range(300)], [r.random() for _ in range(300)]
    q = mixing.flight(sizes, p, 1)
    assert sum(0 < v < 1 for v in q) <= 2 and abs(sum(q) - sum(p)) < 1e-6 and abs(np.dot(q, sizes) - np.dot(p, sizes)) < 1e-3


def test_mix_of_nothing(spark):
    assert rows(mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long"))) == []
    zero = rows(mixing.mix(spark.createDataFrame([(1, "a", 0), (2, "b", None)], "doc_id long, source string, size long")))
    assert [o["taken"] for o in zero] == [0, 0]
