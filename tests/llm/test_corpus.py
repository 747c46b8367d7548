"""Corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, decontaminate, html_text, huffman, langid, licenses, minhash, pii, sentencepiece_viterbi, token_files, toxicity
from marlstone.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "x", "a\n\nb  c", "é日本 𝄞", "word " * 5000, "same text twice here", "same text twice here", "12345 67890"]


def docs(spark, texts, extra=True):
    d = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    return d.withColumn("score", F.lit(9)).withColumn("n", F.lit(1)) if extra else d  # names that clash with results


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode()) if t else []


def test_language_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    net = langid.train(["the and of"] * 5 + ["der die das"] * 5, ["en"] * 5 + ["de"] * 5)
    got = {x["doc_id"]: x for x in langid.identify(docs(spark, ODD), net).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4 and got[3]["lang_pred"] != "und"
    assert langid.identify(docs(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).first()["lang_pred"] == "und"
    assert langid.identify(docs(spark, ODD).limit(0), net).count() == 0
    assert [langid.has_letter(t) for t in ("½ ² Ⅷ ①", "½a", "_1", "é", "١٢", "日")] == [False, True, False, True, False, True]


def test_folded_tables_give_the_filters_responses():
    net = langid.train(["the and of it"] * 8 + ["der die das"] * 8, ["en"] * 8 + ["de"] * 8, epochs=1)
    x = langid.windows(b"some bytes of a window", net.window)
    want = [max(sum(t[k][x[0, i + k]] for k in range(w))[f] for i in range(net.window - w + 1)) for w, t in net.filters.items() for f in range(t.shape[2])]
    assert np.allclose(net.pooled(x)[0], np.maximum(np.array(want) + net.bias, 0), atol=1e-4)


def test_toxicity(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = toxicity.rate(d, lab).join(lab.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    hit = {(x["y"], x["toxic"]): x["count"] for x in r.groupBy("y", "toxic").count().collect()}
    assert hit.get((1, True), 0) > 0.85 * (hit.get((1, True), 0) + hit.get((1, False), 0))
    assert hit.get((0, True), 0) < 0.05 * hit[(0, False)]
    empty = toxicity.rate(docs(spark, ODD), lab.limit(0))
    assert empty.where("toxic").count() == 0 and empty.count() == len(ODD)
    m = toxicity.fit(["bad awful"] * 9 + ["good nice"] * 9, [1] * 9 + [0] * 9)
    assert (np.diff(m.thresholds) > 0).all()


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
        "<article><h1>Head &amp; line</h1><p>First <b>bold</b>\n  words &eacute;&#233; here.</p><p>Ok.</p><ul><li>One<li>Two</ul><aside>Side</aside></article>"
        "<div class='comments'><p>I am a reader who says a lot of things in this comment, and it is of some length.</p></div><footer>Foot</footer><script>var x='<p>no</p>'</script></body></html>"
    )
    assert html_text.main_text(page) == "Head & line First bold words éé here. Ok. One Two"
    plain = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><p>" + "This is the text of a page and it has the words that make it a text. " * 5 + "</p><p>Short.</p><div>Copyright</div><div class=ad>" + "The best of all that you can buy in this shop is here for you. " * 5 + "</div></body>"
    assert html_text.main_text(plain).startswith("This is the text") and "best of all" not in html_text.main_text(plain)
    nested = "<main class='content-header'><article class='post'><p>The text that we want to keep in this page, and it is long enough.</p></article><article class='comment'><p>I have read this text and I do not think that it is right at all.</p></article><div class='story-notice'>We use cookies to make this site better for all of our readers.</div></main>"
    assert html_text.main_text(nested) == "The text that we want to keep in this page, and it is long enough."
    pages = spark.createDataFrame([(1, "u", None, 5), (2, "u", "", 5), (3, "u", "<p>", 5), (4, "u", "<" * 3000, 5), (4, "u", "a &amp;amp; b", 5)], "page_id long, url string, html string, n_chars int")
    got = html_text.extract(pages).orderBy("page_id", "n_chars").collect()
    assert [r["text"] for r in got[:3]] == ["", "", ""] and got[4]["n_chars"] == len(got[4]["text"]) and any(r["text"] == "a &amp; b" for r in got)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)] + [(90, None), (91, [0.0] * 6), (92, [float("nan")] * 6), (93, [None] * 6), (94, [1.0, 2.0]), (100, [1.0] * 6), (101, [1.0] * 6), (120, [3.0, 4.0])]
    d = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = collections.defaultdict(list)
    for r in ann.search(d, F.col("vec_id") % 20 == 0, k=5, rows_per_tile=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = [(i, np.array(v)) for i, v in vecs if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for i, q in ok:
        if i % 20 == 0:
            want = sorted(((-float(np.add.accumulate(q * x)[-1]), j) for j, x in ok if j != i and len(x) == len(q)))[:5]
            assert [(j, -s) for s, j in want] == got[i]
    assert 92 not in got and ann.search(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(str(i), " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 20)))) for i in range(25)] + [("n", None), ("e", ""), ("0", "b a")]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(150)] + ODD
    win = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            win[tuple(w[k : k + n])].add(i)
    b = spark.createDataFrame(items, "item_id string, text string")
    for chars in (10**6, 120):  # one block of items, and several
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.scan(docs(spark, texts), b, shard_words=300, max_chars=chars).collect()}
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for key, names in win.items():
                for k in range(len(w) - len(key) + 1):
                    if tuple(w[k : k + len(key)]) == key:
                        hit |= set(range(k, k + len(key)))
                        found |= names
            assert got[i] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.scan(docs(spark, texts), b.limit(0)).where("n_hit > 0").count() == 0
    left = decontaminate.remove(docs(spark, texts), b)
    assert left.columns == docs(spark, texts).columns and left.count() == sum(not g[-1] for g in got.values())
    m = decontaminate.matches(docs(spark, ["x " + items[3][1] + " y"]), b.where("item_id = '3'")).collect()
    assert max(r["n_words"] for r in m) == len(words(items[3][1]))


def test_viterbi_is_the_best_path_and_comes_back(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    p = sentencepiece_viterbi.load(path)
    scores = {}

    def walk(node, head):
        for c, (s, i, below) in node.items():
            if s is not None:
                scores[head + c] = (s, i)
            walk(below, head + c)

    walk(p.trie, "")
    codec = sentencepiece_viterbi.Codec(p)
    rng = random.Random(5)
    texts = ["  a  b\n\tc ", "日本語 テキスト 𝄞", "a" * 500, "".join(rng.choice("abc é") for _ in range(400)), "    ", "x", "the cat"]
    for t in texts:
        s = "▁" + t.replace(" ", "▁")
        best = [(0.0, 0, [])] + [(float("-inf"), 0, [])] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - p.longest), j):
                piece = scores.get(s[i:j]) or ((p.unknown, None) if j == i + 1 else None)
                if piece and best[i][0] + piece[0] > best[j][0]:
                    best[j] = (best[i][0] + piece[0], i, [piece[1]] if piece[1] is not None else [p.bytes_at[b] for b in s[i:j].encode()])
        ids, k = [], len(s)
        while k:
            ids = best[k][2] + ids
            k = best[k][1]
        assert codec.encode(t).tolist() == ids and np.frombuffer(codec.stream(" " + t), np.int32).tolist() == ids
        assert codec.decode(codec.encode(t)) == t
    got = {r["doc_id"]: r for r in sentencepiece_viterbi.encode(docs(spark, ODD), path).collect()}
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 0 and all(r["round_trip"] for r in got.values())
    back = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(docs(spark, ODD), path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}


def test_viterbi_agrees_with_the_library_in_its_unigram_mode():
    """The model's bytes with its type set to unigram: the first of the library's n best segmentations."""
    import sentencepiece as spm

    path = tokenizer_path("piece_bpe_32k.model")
    data = open(path, "rb").read()

    def varint_of(b, p):
        n = s = 0
        while True:
            n |= (b[p] & 127) << s
            p += 1
            if b[p - 1] < 128:
                return n, p
            s += 7

    p, out = 0, b""
    while p < len(data):
        start = p
        tag, p = varint_of(data, p)
        assert tag & 7 == 2
        n, p = varint_of(data, p)
        body = data[p : p + n]
        p += n
        if tag >> 3 == 2:  # the trainer's specification: its field 3 is the type
            q, at = 0, None
            while q < len(body):
                field = q
                kind, q = varint_of(body, q)
                if kind == 3 << 3:
                    at = q
                if kind & 7 == 0:
                    _, q = varint_of(body, q)
                elif kind & 7 == 2:
                    m, q = varint_of(body, q)
                    q += m
                else:
                    q += 4 if kind & 7 == 5 else 8
            assert at is not None and body[at] == 2 and field < len(body)
            body = body[:at] + b"\x01" + body[at + 1 :]
        out += data[start : p - n] + body
    sp = spm.SentencePieceProcessor(model_proto=out)
    codec = sentencepiece_viterbi.Codec(sentencepiece_viterbi.load(path))
    for t in ["the cat sat on the mat", "thonwh erinthe. Anble", "Éeau, deux ñandú straße"]:
        ids = codec.encode(t).tolist()
        score = lambda x: sum(sp.get_score(i) for i in x)
        best = sp.nbest_encode_as_ids(t, 2)[0]
        assert ids == best or abs(score(ids) - score(best)) < 1e-3


def test_licenses(spark):
    texts = [*ODD, "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\nmit license mit license", "LICENSED UNDER CC BY-NC 4.0.", "this work is licensed under the gnu general public license, version 3."]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i]["n_words"] for i in range(len(texts))] == [len(words(t)) for t in texts]
    n = len(ODD)
    assert (got[n]["n_base"], got[n]["first_word"], got[n]["base_labels"], got[n]["labels"]) == (1, 3, "mit", "mit,mit-notice")
    assert (got[n + 1]["n_base"], got[n + 1]["first_word"], got[n + 1]["last_word"], got[n + 1]["base_labels"]) == (3, 4, 11, "apache,mit")
    assert (got[n + 2]["n_base"], got[n + 2]["labels"], got[n + 2]["first_word"]) == (0, "cc-by,cc-by-nc", None) and got[n + 2]["score"] == 1.0
    assert got[n + 3]["labels"] == "gpl,gpl-notice" and got[0]["labels"] == "" and got[0]["score"] == 0
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0


def test_scattered_words_are_no_notice(spark):
    rest = [f"word{k}" for k in range(2000)]
    scattered = list(rest)
    for k, w in enumerate(["licensed", "under", "cc", "by", "released", "the", "mit", "license"]):
        scattered[100 + 230 * k] = w
    notice = "released under the mit license".split()
    texts = [" ".join(scattered), *[" ".join(rest[:k] + notice + rest[k:]) for k in (0, 29, 61, 64, 1000, 1995, 2000)]]
    got = [r["labels"] for r in licenses.scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == "" and all(g == got[1] and "mit-notice" in g for g in got[1:])


@pytest.mark.parametrize("width", [16, 40, 76])
def test_wrapped_licenses(spark, width):
    templates = dict(licenses.TEMPLATES)
    labels = ["bsd-grant", "gpl-grant", "isc-grant", "mit-grant", "unlicense"]
    texts = ["/*\n" + "\n".join(" * " + x for x in textwrap.wrap("Copyright someone, all of it. " + templates[k] + " and so on", width)) + "\n */" for k in labels]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert all(k in got[i]["labels"].split(",") and got[i]["score"] == 1.0 for i, k in enumerate(labels))
    far = licenses.scan(docs(spark, ["released under\n" + "other words\n" * 60 + "the mit\nlicence license"])).first()
    assert far["labels"] == "" and far["score"] == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for k, p in BASE:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or k == "card" and 16 <= len(d) <= 19 and total % 10 == 0 or k == "phone" and 8 <= len(d) <= 15:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    rng = random.Random(6)
    texts = [*ODD, "a@b.c@d.e x@y", "a@b.c_d@e.f", "x@a..b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "+1 (017) 555-7713 +1", "é 4111111111111111 日本 +81 90-1234-5678.", "4111-1111--1111 4111111111111111", "1 " * 3000, "a@b" + ".c" * 2000, " ".join(["77.88.99.1 joe@x.org"] * 400)]
    texts += ["".join(rng.choice(["4111111111111111", "4", "1", ".", " ", "-", "a@b.c", "+1", "(", "1.2.3.4", "@", "_", "%", "é"]) for _ in range(12)) for _ in range(600)]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        assert got[i]["spans"].split(",")[: len(want)] == (want or got[i]["spans"].split(",")[:0])
    clean = pii.redact(docs(spark, [None, "", "mail joe@x.org, ip 1.2.3.4 é", "none"]))
    assert [r["text"] for r in clean.orderBy("doc_id").collect()] == [None, "", "mail [EMAIL], ip [IP] é", "none"] and clean.columns == docs(spark, [""]).columns
    assert pii.find(docs(spark, texts).limit(0)).count() == 0


def test_many_cells_of_a_kind_leave_rare_kinds_in_place(spark):
    # Secrets of some 100,000 shapes, each twice, and handles of two shapes.
    many = spark.range(20 * 20 * 7 * 5 * 4 * 3).select(F.expr("""concat(
        element_at(array('x ', 'x=', 'token ', 'token='), cast(id div 14000 % 4 as int) + 1), repeat('1', cast(id % 20 + 1 as int)), repeat('a', cast(id div 20 % 20 + 1 as int)),
        repeat('A', cast(id div 2800 % 5 as int)), repeat('-', cast(id div 400 % 7 as int)), element_at(array(' ', '"', '.'), cast(id div 56000 as int) + 1))""").alias("text"))
    rare = spark.createDataFrame([("write to joe at site dot com",), ("anna.b [at] place.org",)], "text string")
    model = pii.fit(many.unionByName(many).unionByName(rare))
    got = [r["spans"] for r in pii.find(docs(spark, ["ask joe at site dot com now"]), model).collect()]
    assert got == ["handle:4:23"]


def test_boosted_trees_as_columns_give_the_fits_scores(spark):
    cells = [((a, b) + (0,) * 8, (a > 2) * 5 + (b > 1), 6) for a in range(6) for b in range(3)]
    start, trees = pii.fit_trees(cells)
    d = spark.createDataFrame([(a, b) for a in range(6) for b in range(3)], "a int, b int")
    col = F.lit(start)
    for t in trees:
        col = col + pii._tree_column(t, [F.col("a"), F.col("b")])
    for r in d.withColumn("s", col).collect():
        assert abs(r["s"] - pii.tree_score(start, trees, (r["a"], r["b"]) + (0,) * 8)) < 1e-9


def components(rows, size=4):
    par = {i: i for i, _ in rows if i is not None}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
    live = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, a) in enumerate(live):
        for j, b in live[:x]:
            n = len(a & b)
            if n and 100 * n >= 80 * (len(a) + len(b) - n):
                par[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=str)


@pytest.mark.parametrize("group_docs", [1024, 30])
def test_near_duplicates(spark, group_docs):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocab) for _ in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(100)] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([rng.choice(vocab) for _ in range(40)] + base[:50])) for i in range(80)]
    rows += [(400, ""), (401, None), (402, "a b"), (403, "A  b"), (None, "a b"), (404, rows[0][1]), (404, rows[150][1]), (10, "zz zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("cls", F.lit("x"))
    got = minhash.near_duplicates(d, group_docs=group_docs)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == components(rows)
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_huffman():
    rng = np.random.default_rng(8)
    counts = rng.zipf(1.4, 3000).clip(0, 10**8)
    counts[::5] = 0
    lengths = huffman.code_lengths(counts, 14)
    assert lengths.max() <= 14 and abs((0.5 ** lengths[lengths > 0].astype(float)).sum() - 1) < 1e-12
    code = huffman.Code(lengths)
    ids = rng.choice(3000, 5000, p=counts / counts.sum())
    data, marks = code.encode(ids)
    sizes = np.minimum(huffman.BLOCK, len(ids) - np.arange(len(marks)) * huffman.BLOCK)
    assert (code.decode(data, marks, sizes) == ids).all()
    assert (code.decode(data, marks[3:4], sizes[3:4]) == ids[3 * huffman.BLOCK : 4 * huffman.BLOCK]).all()
    one = huffman.Code(huffman.code_lengths(np.array([0, 0, 7])))
    assert (one.decode(*one.encode(np.array([2, 2])), np.array([2])) == [2, 2]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = ODD + ["a  b", "a \nb", "a\n b", " x", "x ", "it's 'tis \t x", "x y 　z", "\0a b", "<|endoftext|> a", "don't, stop! 3.5"] + ["".join(rng.choice(" ab'1\n\t.é ,") for _ in range(30)) for _ in range(300)]
    d = docs(spark, texts).unionByName(docs(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(token_files.round_trip(d.repartition(3), path, 2).collect(), key=lambda r: r["start"])
    at = 0
    for r, t in zip(got, ["null id", *texts]):
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r["doc_id"] for r in got] == [None, *range(len(texts))]
    assert token_files.round_trip(d.limit(0), path, 2).count() == 0


def test_words_before_marks_are_encoded_once():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    rng = random.Random(4)
    stems = ["house", "x", "9", "h2", "²", "ª", "½", "é", "e\u0301", "ɏ", "ɐ", "ß", "日本", "ё", "\0", "don't", "..", "-", "<|endoftext|>", "¡", "\n", "a\tb", ""]
    words = [w + m for w in stems for m in [*".,!?;:", "...", ".,", "", "-", "?!"]]
    texts = ["start " + " ".join(rng.sample(words, 9)) for _ in range(400)] + ["start " + w for w in words]
    for given in (texts, list(reversed(texts))):
        ids = token_files.WordIds(path, 2)
        ids.step, ids.line = 50, 7
        for k in range(0, len(given), 60):
            got = [np.frombuffer(i, ids.kind).tolist() for i in ids.ids(given[k : k + 60])]
            assert got == [e.ids + [2] for e in tk.encode_batch(given[k : k + 60], add_special_tokens=False)]

    class Counted:
        def __init__(self, tk):
            self.tk, self.words = tk, 0

        def encode_batch_fast(self, texts, **more):
            self.words += sum(len(t.split()) for t in texts)
            return self.tk.encode_batch_fast(texts, **more)

    ids = token_files.WordIds(path, 2)
    ids.tk = Counted(ids.tk)
    ids.learn(["house", "house.", "house,", "garden!", "garden?"])
    assert ids.tk.words == 2


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = d.columns
    kept = {}
    for name, stage in c.STAGES:
        before = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
        d = stage(spark, d, DATA).cache()
        kept[name] = {r["doc_id"] for r in d.select("doc_id").collect()}
        assert kept[name] <= before.keys()
        if name == "near_duplicates":
            assert kept[name] == {i for i, _, root in components(list(before.items()), 5) if root == i}
        if name == "personal_data":
            assert not [r for r in d.collect() if base_spans(r["text"] or "") and "@" in r["text"]]
        if name != c.STAGES[-1][0]:
            assert d.columns == columns
    assert d.where("NOT round_trip").count() == 0
