"""The training-data operators against brute force, and on nulls, empty tables, repeated rows, long texts and clashing names."""

import base64
import hashlib
import html
import math
import re
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from narratix.llm import ann, decontam, extract, langid, lm, packing, pii, queries, simhash, toxicity, warc
from narratix.llm.common import table
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
LONG = "word " * 60_000


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def odd(spark, docs):
    """The documents and hard cases beside them: nulls, empty and long texts, repeated rows, clashing columns."""
    extra = [(None, None), (None, "null id"), (10**6, ""), (10**6 + 1, " \n\t"), (10**6 + 2, LONG), (10**6 + 3, "x" * 50_000), (10**6 + 4, None)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, DOCS))
    rows = rows.unionByName(rows.where("doc_id < 5"))
    return rows.withColumns({"row": F.lit(1), "fp": F.lit(2), "_hash": F.lit(3), "key": F.lit(4), "rank": F.lit(5), "score": F.lit("s"), "n_words": F.lit(6)})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def hard(spark, docs):
    return odd(spark, docs).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, duck, name):
    def rows(frame):
        frame = frame[sorted(frame.columns)].astype(object)
        return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))

    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


def test_packing(spark, hard, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hard = hard.unionByName(spark.createDataFrame([(10**6 + 9, "a <|endoftext|> b<|endoftext|>")], DOCS), allowMissingColumns=True)
    rows = hard.select("doc_id", "text").collect()
    ids = {(r["doc_id"], r["text"]): np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    got = packing.pack(hard).toPandas()
    want = Counter()
    for r in rows:
        x = ids[r["doc_id"], r["text"]]
        want.update([(r["doc_id"], len(x))])
    whole = got[got["start"] == 0]
    assert Counter((None if d != d else int(d), int(n)) for d, n in zip(whole["doc_id"], whole["doc_tokens"], strict=True)) == want
    assert int(got["length"].sum()) == sum(len(ids[r["doc_id"], r["text"]]) for r in rows)
    by_id = {k[0]: x for k, x in ids.items() if k[0] is not None}
    for r in got[got["doc_id"].notna()].itertuples():
        assert zlib.crc32(by_id[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 1024 and all(n == 1024 or n & (n - 1) == 0 for n in sizes)
    assert packing.pack(empty).count() == 0


def test_packing_of_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    runs = [" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 1_000_000 + "b.", "é\n" + "\t\u3000" * 500_000 + "\n7 \n", (" " * 100_000 + "x") * 3, " " * 99_999 + "\x1f" + " " * 100_001 + "y", " " * 100_001 + "<|endoftext|>" + "\n" * 100_002 + "x"]
    got = packing.pack(spark.createDataFrame(list(enumerate(runs)), DOCS)).toPandas()
    for k, text in enumerate(runs):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = got[got["doc_id"] == k]
        assert own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())


def whole(pieces, documents, size=1024):
    """Every id in one piece, every sequence gapless and full, but for powers of two."""
    assert pieces.groupby("sequence_id")["length"].sum().map(lambda n: n == size or n & (n - 1) == 0).all()
    pieces = pieces.sort_values(["sequence_id", "offset"])
    assert (pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"] == pieces["offset"]).all()
    assert pieces["length"].sum() == pieces[pieces["start"] == 0]["doc_tokens"].sum() and (pieces["start"] == 0).sum() == documents


@pytest.mark.parametrize("counts", [{5: 1}, {512: 3}, {700: 5000}, {1023: 3000, 900: 2000}, {500: 10, 524: 10}, {1: 5}, {512: 1}, {}])
def test_plans_without_exact_patterns(counts):
    """Lengths that add up to no sequence, or that their pairs fill already."""
    plan = packing.Plan(counts, 0)
    taken = {x: int(plan.taken[x]) for x in counts}
    assert all(0 <= taken[x] <= n for x, n in counts.items()) and plan.next * 1024 == sum(x * n for x, n in taken.items())
    sequence, offset = plan.place(np.array([x for x, n in counts.items() for _ in range(n)], np.int64), np.array([k for n in counts.values() for k in range(n)], np.int64))
    assert (sequence >= 0).sum() == sum(taken.values()) and plan.tail[-1] == sum(x * (n - taken[x]) for x, n in counts.items())


@pytest.mark.parametrize("texts", [["alpha beta gamma delta"], [""], [None], ["word " * 511], ["word " * 700] * 30, ["a"] * 20_000 + ["b c"]])
def test_packing_small_and_equal(spark, texts):
    """One document, tables whose lengths fill nothing, and one row repeated very often (the same id, too)."""
    began = time.time()
    whole(packing.pack(spark.createDataFrame([(7, t) for t in texts], DOCS).repartition(4)).toPandas(), len(texts))
    assert time.time() - began < 60


def test_column_generation():
    lengths, counts = np.array([200, 300, 324, 500, 512, 524]), np.array([10, 7, 10, 10, 4, 3])
    patterns, uses = packing.column_generation(lengths, counts)
    assert (patterns @ lengths == 1024).all() and (patterns.T @ uses <= counts + 1e-6).all()
    # 10 of 200 + 324 + 500 and 2 of 512 + 512 are one way; no way fills more than all tokens
    assert 12 * 0.99 <= uses.sum() <= lengths @ counts / 1024
    whole = packing.rounded(patterns, uses, counts)
    assert (patterns.T @ whole <= counts).all() and whole.sum() >= 11


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    bits = np.array([[v >> b & 1 for b in range(64)] for v in h]).sum(0) if h else np.zeros(64)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    v = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(v[k] ^ v[k + 1 :]) <= 2):
            a, b = sorted((find(i), find(ids[k + 1 + j])))
            root[b] = a
    return {i: find(i) for i in ids}


def test_repeated_rows_are_one(spark):
    """Rows with one id and text: the least in the other columns stays, whatever the order of rows."""
    rows = [(3, "same text here", lang, None) for lang in ("b", "a", "c", None)] * 50 + [(None, "same text here", "z", 1)] * 9 + [(9, "other words are these", "a", 2)] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    got = [sorted(map(tuple, simhash.deduplicate(frame.orderBy(F.rand(k)).repartition(3)).collect())) for k in range(2)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [3, 9]


def test_hot_nodes_are_dealt_apart(spark):
    """A star of a node with more links than one task should take, and a join with hot keys."""
    from narratix.llm import common

    edges = spark.range(1, 30_001).selectExpr("0L as a", "id as b")
    got = simhash.components(edges)
    assert got.count() == 30_001 and got.where("root <> 0").count() == 0
    left = spark.range(40_000).selectExpr("if(id % 3 > 0, 5, id) as k", "id")
    right = spark.range(40_000).selectExpr("id as k", "id * 2 as v")
    out = common.joined_apart(left, right, "k", left.groupBy("k").agg(F.count("*").alias("n")), "left", 1000)
    assert out.count() == 40_000 and out.where("v <> k * 2 or v is null").count() == 0


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash(hard, empty, hot):
    rows = {r["doc_id"]: r["text"] for r in hard.collect() if r["doc_id"] is not None}
    got = simhash.near_duplicates(hard, hot=hot).where("doc_id is not null").collect()
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == {k: fingerprint(t) for k, t in rows.items()}
    want = brute_components({k: fingerprint(t) for k, t in rows.items()})
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = simhash.deduplicate(hard, hot=hot)
    assert kept.columns == hard.columns
    assert Counter(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == Counter(set(want.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_tally(spark):
    """Pairs that share six positional bytes are retained, whatever the bits; those of fewer are not."""
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(60):
        x = rng.integers(0, 256, 8, dtype=np.uint8)
        fps.add(int(x.view(np.int64)[0]))
        for n in (1, 2, 2, 3, 4):
            y = x.copy()
            y[rng.choice(8, n, replace=False)] ^= rng.integers(1, 256, n, dtype=np.uint8)
            fps.add(int(y.view(np.int64)[0]))
    fps = sorted(fps)
    members = simhash._listed(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {tuple(r) for r in simhash.tallied(members).collect()}
    b = np.array(fps).view(np.uint8).reshape(-1, 8)
    same = {(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero((b == b[i]).sum(1) >= 6) if i < j}
    near = {(x, y) for x, y in same if (x ^ y).bit_count() <= 2}
    assert got <= same and near <= got


def test_simhash_chains(spark):
    """Links over a near-copied group with chains and lists of all sizes."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(150):
            x ^= 1 << int(rng.integers(0, 63)) if rng.random() < 0.8 else 7 << int(rng.integers(0, 60))
            fps.add(x)
    fps = sorted(fps)
    want = brute_components({k: x for k, x in enumerate(fps)})
    dense = sorted({int(base[0]) ^ (int(k) << 8) for k in rng.integers(0, 1 << 16, 400)})
    fps = sorted({*fps, *dense})
    want = brute_components({k: x for k, x in enumerate(fps)})
    for hot in (2, 64, 1000):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), hot)).collect()}
        assert {x: got.get(x, x) for x in fps} == {x: fps[want[k]] for k, x in enumerate(fps)}


def test_extraction(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r["page_id"]: r for r in queries.op3_extraction(spark, sf).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body))
        text = "\n\n".join(x for x in parts if x)
        assert got[p["page_id"]]["text"] == text and got[p["page_id"]]["n_chars"] == len(text)


def test_extraction_markup(spark, empty):
    same = "<div><p>Read our daily letter with all the latest stories and offers today.</p></div>"
    own = [f"<html><body><div class='menu'>m</div>{same}<div>Story {k} begins with words of its own number {k} here.<br>Two &amp; two.</div><form>f</form><div id=comments>c</div>" for k in range(12)]
    article = "<body><header>h</header><article><header><h1>T</h1></header><p class='notice'>n<p>One<aside>a</aside><li>x<td>y</article><section class=related>r"
    rows = [(k, f"http://h.example/{k}", x) for k, x in enumerate(own)] + [(100, "http://g.example/", article), (101, None, None), (102, "x", ""), (103, "http://g.example/q", "<p hidden>a<b>c</b"), (100, "http://g.example/", article)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2)).withColumn("shard", F.lit(3))
    got = extract.extract(frame).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[3] == "Story 3 begins with words of its own number 3 here. Two & two."
    assert by[100] == "T\n\nOne\n\nx y" and by[101] == by[102] == ""
    quoted = [(k, f"http://q.example/{k}", f"<article><p>{'A passage that many pages quote word for word. ' * 8}<p>Own {k}</article>") for k in range(30)]
    got = extract.extract(spark.createDataFrame(quoted[:4] + [(9 + k, f"http://q.example/n{k}", f"<article><p>New {k} {'w%d ' % k * 9}</article>") for k in range(9)], "page_id long, url string, html string")).collect()
    assert all("A passage" in r["text"] for r in got if r["page_id"] < 4)
    assert extract.extract(frame.limit(0)).count() == 0


PAGES = "page_id long, url string, html string"


def test_extraction_of_large_pages(spark):
    passage = "<p>Every story here may be read again in our archive of all years.</p>"
    rows = [(k, f"http://h.example/{k}", f"<script>{'x' * size}</script><{tag}>{passage}<p>Story {k} of {tag} {' '.join(f'w{k}x{j}' for j in range(9))}</p></{tag}>") for size, tag, n in ((60_000, "article", 40), (190_000, "section", 12)) for k in range(n)]
    for tag in ("article", "section"):
        got = extract.extract(spark.createDataFrame([r for r in rows if f"<{tag}>" in r[2]], PAGES)).collect()
        assert got and all(r["text"].startswith("Story") for r in got)


def test_extraction_of_copies(spark, monkeypatch):
    def pages(host, tag, copies, others, shared=""):
        text = [f"{shared}<p>A story of {host} that was copied whole, word for word, many times.</p>"] * copies + [f"{shared}<p>Own story {k} {' '.join(f'{host}{k}x{j}' for j in range(9))}</p>" for k in range(others)]
        return [(f"http://{host}.example/{k}", f"<{tag}>{x}</{tag}>") for k, x in enumerate(text)]

    line = "<p>This line of the house stands above every page that we print here.</p>"
    rows = [*pages("a", "section", 3, 0), *pages("b", "section", 3, 5), *pages("c", "section", 30, 30), *pages("d", "article", 3, 5), *pages("e", "article", 30, 30), *pages("f", "article", 40, 2)]
    rows += [*pages("g", "section", 30, 30, line), *pages("h", "article", 30, 30, line)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], PAGES).repartition(4)
    for size in (40, 4):
        monkeypatch.setattr(extract, "PAGES", size)
        got = {r["page_id"]: r["text"] for r in extract.extract(frame, 100).collect()}
        assert all(got[k] == re.sub("<[^>]*>", "", page.replace(line, "")) for k, (_, page) in enumerate(rows))


def test_extraction_shards_agree(spark, monkeypatch):
    """Shards of a few pages, with stretches broadcast or dealt, decide as one shard of the whole host does."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        parts = [f"Line {j} stands on about {5 * j + 2} of a hundred pages of this host" for j in range(14) if rng.random() < 0.05 * j + 0.02]
        tag = "article" if k % 3 else "section"
        rows.append((k, f"http://h.example/{k}", f"<{tag}>{''.join(f'<p>{x}</p>' for x in [*parts, f'Own {k}'])}</{tag}>"))
    frame = spark.createDataFrame(rows, PAGES)

    def run(pages, stretches, shard_bytes):
        monkeypatch.setattr(extract, "PAGES", pages)
        monkeypatch.setattr(extract, "STRETCHES", stretches)
        return sorted(map(tuple, extract.extract(frame, shard_bytes).collect()))

    whole = run(1000, 10**6, 10**9)
    count = Counter(x for r in rows for x in set(re.findall("Line [0-9]+ [^<]+", r[2])))
    for (_, _, page), r in zip(rows, whole, strict=True):
        need = max(10, 60) if "<article>" in page else max(3, 12)
        assert r[2].split("\n\n") == [x for x in re.findall("<p>(.*?)</p>", page) if count[x] < need]
    assert run(6, 10**6, 100) == whole and run(30, 10**6, 100) == whole and run(30, 0, 100) == whole


def test_warc(spark, sf):
    pages = table(spark, sf, "pages")
    rows = pages.select("page_id", "url", F.when(F.col("page_id") % 3 == 0, F.lit("x")).when(F.col("page_id") % 7 == 0, None).otherwise(F.col("html")).alias("html"))
    rows = rows.unionByName(rows.where("page_id < 4")).unionByName(spark.createDataFrame([(900, None, "é\r\n\r\n" * 30_000), (None, "u v\r\nw", "x")], "page_id long, url string, html string")).withColumn("sha1", F.lit(1))
    index = warc.write(rows, file_bytes=20_000)
    got = warc.read(index, gap=100, block_bytes=30_000).collect()
    data = rows.collect()
    assert len(got) == len(data)
    payload = {r["page_id"]: (r["html"] or "").encode() for r in data}
    last = {}
    for k, p in payload.items():
        last[p] = max(last.get(p, -1), -1 if k is None else k)
    for r in got:
        p = payload[r["page_id"]]
        assert r["payload_bytes"] == len(p) and r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        if r["page_id"] in (None, last[p]):
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == p
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == last[p] and r["payload"] is None
    some = warc.read(index.where("page_id % 5 = 0"), payloads=False).collect()
    assert {r["page_id"] for r in some} == {k for k in payload if k is not None and k % 5 == 0}
    small = warc.read(warc.write(rows, least=2)).where("payload_bytes < 2").collect()
    assert small and all(r["record_type"] == "response" for r in small)
    assert warc.read(warc.write(rows.limit(0))).count() == 0


def brute_windows(docs, items):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))
    windows: dict = {}
    for i, t in items:
        if w := words(t):
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, sf, hard, empty):
    items = table(spark, sf, "benchmark")
    short = spark.createDataFrame([(7001, "Word word"), (7002, ""), (7003, None), (7004, "ing"), (7001, "word word")], "item_id long, text string")
    for bench, blocks in ((items, 8_000_000), (items, 1000), (items.unionByName(short), 2000)):
        got = decontam.contamination(hard, bench, block_bytes=blocks).drop("longest_match", "longest_at").collect()
        want = brute_windows([(r["doc_id"], r["text"]) for r in hard.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
        assert sorted(map(tuple, got), key=str) == want
    kept = decontam.decontaminate(hard, items)
    assert kept.columns == hard.columns and kept.count() == sum(not x[-1] for x in brute_windows([(r["doc_id"], r["text"]) for r in hard.collect()], [(r["item_id"], r["text"]) for r in items.collect()]))
    assert decontam.contamination(empty, items).count() == 0
    assert not decontam.contamination(hard, items.limit(0)).where("contaminated or n_hit > 0").count()


def test_many_blocks_and_shared_prompts(spark, sf):
    """200 blocks, and a prompt that 10,000 items and many documents share, give what brute force does."""
    rng = np.random.default_rng(8)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    size = sum(len(r["text"].encode()) for r in items.collect())
    want = brute_windows([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    got = decontam.contamination(docs, items, block_bytes=max(1, size // 200))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == want
    prompt = "Read the text below and say which of its five words of the house stands last of all"
    data = [(k, f"{prompt} q{k} r{k} {' '.join(f'w{x}' for x in rng.integers(0, 50, 3))}") for k in range(10_000)]
    texts = [(k, f"own {k} {prompt} {' '.join(f'w{x}' for x in rng.integers(0, 50, 5))} {prompt if k % 3 else ''} q{k} r{k}") for k in range(400)] + [(900, "nothing here")]
    began = time.time()
    for size in (8_000_000, 400_000):
        got = decontam.contamination(spark.createDataFrame(texts, DOCS), spark.createDataFrame(data, "item_id long, text string"), block_bytes=size).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == brute_windows(texts, data)
    assert time.time() - began < 240


def test_longest_matches(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 4, n))
    docs, items = [(k, text(60)) for k in range(40)], [(k, text(20)) for k in range(6)]
    got = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), window=5).collect()
    for r in got:
        w = docs[r["doc_id"]][1].split()
        best = 0
        for _, t in items:
            q = t.split()
            for a in range(len(w)):
                for b in range(len(q)):
                    n = 0
                    while a + n < len(w) and b + n < len(q) and w[a + n] == q[b + n]:
                        n += 1
                    best = max(best, n)
        assert r["longest_match"] == (best if best >= 5 else 0)


def test_neighbours(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    bad = spark.createDataFrame([(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None] * 64), (905, [float("inf")] * 64), (906, [1.0] * 3), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    hot = rows.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.array(*[F.lit(0.5)] * 64).cast("array<float>")).otherwise(F.col("embedding")))
    for frame in (rows.unionByName(bad), hot.unionByName(bad), rows.limit(5).unionByName(bad).unionByName(rows.limit(2))):
        frame = frame.withColumn("rep", F.lit(1)).withColumn("list", F.lit(2))
        got: dict = {}
        for r in ann.search(frame, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r)
        data = {r["vec_id"]: np.array(r["embedding"], float) for r in frame.collect() if r["vec_id"] is not None and r["vec_id"] < 900}
        ids = sorted(data)
        v = np.stack([data[i] for i in ids])
        hits = total = 0
        for q in (i for i in ids if i % 20 == 0):
            s = v @ data[q]
            best = [ids[k] for k in sorted(range(len(ids)), key=lambda k: (-round(s[k], 12), ids[k])) if ids[k] != q][:20]
            mine = got.get(q, [])
            assert [r["rank"] for r in mine] == list(range(1, len(best) + 1)) and all(abs(r["score"] - data[q] @ data[r["vec_id"]]) < 1e-12 for r in mine)
            assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
            hits, total = hits + len({r["vec_id"] for r in mine} & set(best)), total + len(best)
        assert hits >= 0.9 * total
    assert ann.search(rows.limit(0), rows.limit(0)).count() == 0


@pytest.mark.parametrize("most_lists", [4096, 64])
def test_neighbours_of_many(spark, most_lists):
    """60,000 vectors in uneven clusters with uneven norms: recall, the share of the table that a query reads, and the size of lists."""
    import pandas as pd

    rng = np.random.default_rng(5)
    n, centres = 60_000, rng.normal(size=(500, 64))
    group = np.where(rng.random(n) < 0.3, 0, rng.integers(0, 500, n))
    x = ((centres[group] + 0.35 * rng.normal(size=(n, 64))) * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x.tolist())}), "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 200 = 0")
    got: dict = {}
    for r in ann.search(rows, asked, most_lists=most_lists).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(float)
    hits = 0
    for q in range(0, n, 200):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(got) == n // 200 and hits >= 0.9 * 20 * len(got)
    index = ann.indexed(rows, asked, most_lists=most_lists)
    probes = index.probes(index.alike.where("asked > 0").select("rep", "embedding"), 0.2, 200)
    read = probes.join(index.counts, "list").agg(F.sum("n")).first()[0] / len(got)
    assert read < 0.25 * n and index.levels and index.counts.agg(F.max("n")).first()[0] <= 512
    assert index.members.select("rep").distinct().count() == index.vectors


def test_centroid_graph():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(800, 16)).astype(np.float32)
    q = rng.normal(size=(100, 16)).astype(np.float32)
    ids, d = ann.CentroidGraph(c).search(q, 32)
    exact = ((q[:, None] - c[None]) ** 2).sum(2)
    assert np.mean([len(set(ids[k, :10]) & set(np.argsort(exact[k])[:10])) for k in range(100)]) > 9
    assert np.allclose(d[:, 0], exact[np.arange(100), ids[:, 0]], atol=1e-3)


def test_toxicity(spark, hard, empty):
    sf = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    toxic = got[got["toxic"] == 1]["predicted"]
    assert toxic.mean() > 0.8 and got[got["toxic"] == 0]["predicted"].mean() < 0.03
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1), (3, 0), (4, 0), (6, 1)], "doc_id long, toxic int")
    model = toxicity.fit(hard, labels)
    assert toxicity.score(hard, model).where("score between 0 and 1").count() == hard.count()
    assert toxicity.clean(hard, model, 2.0).columns == hard.columns
    none = toxicity.fit(empty, labels)
    assert toxicity.score(hard, none).where("score = 0").count() == hard.count() and toxicity.score(empty, model).count() == 0


PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0
            if (k == 0) or (k == 1 and all(int(x) < 256 for x in m.group().split("."))) or (k == 2 and 12 <= len(digits) <= 19 and luhn) or (k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = ["a@b.c.@d.e x@y 1.2.3.4.5 256.1.1.1 001.02.3.4 +1 (635) 555-6187. +1 23 +12-34-56-78-90-12 4111 1111 1111 1111 4111-1111-1111-1112 é😀a.b+c@d-e.fr", "1 " * 20_000, "a@b.c " * 5000, "a@" + "b.c" * 3000, "1.2.3.4" * 50, "+1+22222222222", "call (212) 555-1234 Mr. John Smith ssn: 123-45-6780"]


def test_personal_data(spark, sf, hard, empty):
    rows = hard.select("doc_id", "text").unionByName(table(spark, "/root/testdata/sf0.01", "documents").select((F.col("doc_id") + 5000).alias("doc_id"), "text")).unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(TRICKY)], DOCS)).withColumn("pos", F.lit(1))
    got, data = pii.spans(rows).collect(), rows.collect()
    want = []
    for r in data:
        s = base_spans(r["text"])
        want.append((r["doc_id"], *(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(",".join(f"{pii.BASE[k]}:{a}:{e}" for a, k, e in s).encode()).hexdigest()))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r["text"] for r in data}
    for r in got:
        if r["doc_id"] is not None:
            listed = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x]
            assert {(pii.BASE[k], a, e) for a, k, e in base_spans(by[r["doc_id"]])} <= set(listed)
            assert [(a, pii.KINDS.index(k)) for k, a, _ in listed] == sorted((a, pii.KINDS.index(k)) for k, a, _ in listed)
    assert "tel:5:19" in next(r["spans"] for r in got if r["doc_id"] == -len(TRICKY))
    clean = pii.redact(rows)
    assert clean.columns == rows.columns and clean.count() == len(data)
    for r in clean.collect():
        assert (r["text"] is None) == (by.get(r["doc_id"]) is None) or r["doc_id"] is None
        assert not [x for x in base_spans(r["text"]) if x[1] in (0, 3)]
    assert pii.spans(empty).count() == 0
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_personal_data_in_long_runs(spark):
    """Runs of a pattern's signs without a match take time by their length, not its square."""
    long = 400_000
    texts = ["a" * long + " x@y.z", "1" * long + "@", "a." * (long // 2) + "@", "a-" * (long // 2) + "1.2.3.4", "1." * (long // 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.spans(rows).collect()}
    assert time.time() - began < 60
    assert [got[k]["n_email"] for k in range(5)] == [1, 0, 0, 0, 0] and [got[k]["n_ip"] for k in range(5)] == [0, 0, 0, 1, long // 8]
    assert got[0]["spans"] == f"email:{long + 1}:{long + 6}" and got[3]["spans"].endswith(f"ip:{long}:{long + 7}")


def test_secrets_of_any_length(spark):
    rng = np.random.default_rng(5)
    signs = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"))
    sizes = [40, 128, 129, 164, 200, 342, 600, 5000]
    tokens = ["k7" + "".join(rng.choice(signs[:k], n - 4)) + "Z9" for k in (62, 64) for n in sizes] + ["0a" * n for n in (64, 65, 300)] + ["X1z2" * 50 + "=="]
    texts = [f"api key: {t} ends" for t in tokens] + [f"password {'-' * n}{tokens[3]}." for n in (1, 5, 255, 256, 400)]
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = {r["doc_id"]: r["m"] for r in pii.candidates(rows).where(f"kind = {pii.KINDS.index('secret')}").collect()}
    assert found == dict(enumerate(tokens + [tokens[3]] * 5))
    assert not [r for r in pii.redact(rows).collect() if any(t in r["text"] for t in tokens)]
    long = 400_000
    hard = ["a-" * (long // 2), "1-" * (long // 2), ("a" * 16 + "-") * (long // 17), ("-" * 256 + "a") * (long // 257), "/" * long, "a1" * long]
    began = time.time()
    got = {r["doc_id"]: r["spans"] for r in pii.spans(spark.createDataFrame(list(enumerate(hard)), DOCS)).collect()}
    assert time.time() - began < 60 and "secret" not in "".join(got[k] for k in range(5))


def test_estimation():
    """Labelers that agree get trusted; a labeler at odds with them does not."""
    patterns = {(4, 1, 1, 0, 0, 1): 50, (4, -1, -1, 0, 0, -1): 50, (4, 1, 1, 0, 0, -1): 5, (4, -1, 0, 0, -1, 1): 5}
    posterior, table_ = pii.expectation_maximisation(patterns)
    assert posterior[4, 1, 1, 0, 0, 1] > 0.9 > 0.1 > posterior[4, -1, -1, 0, 0, -1]
    assert table_[4][0][1][2] > 0.8 and pii.Classifier({}).weights


@pytest.mark.parametrize("frequent", [1 << 20, 50])
def test_language_model(monkeypatch, hard, empty, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    words = lambda s: [*re.findall(r"[^\x20\x09-\x0D]+", lower(s)), None]
    learns = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0
    data = [(r["doc_id"], words(r["text"])) for r in hard.collect()]
    c = Counter(w for i, t in data if learns(i) for w in t)
    n, v = sum(c.values()), len(c)
    got = lm.score(hard).collect()
    want = [(i, not learns(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for i, t in data]
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 4)) for r in got), key=str) == sorted(want, key=str)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert lm.score(empty).count() == 0


def test_language_model_is_normalised():
    """Probabilities of all classes sum to one, and each is the softmax of the products written out."""
    rng = np.random.default_rng(0)
    code = np.unique(rng.integers(0, (lm.CLASSES + 1) ** 2 * lm.CLASSES, 500))
    t = lm.Tables(*[np.zeros(0)] * 3, 0, 0, 0, np.zeros(0), lm.train(code, np.ones(len(code), np.int64), rounds=20))
    last, before, q, b = (x.astype(float) for x in t.model)
    for context in code[:5] // lm.CLASSES:
        p = 10.0 ** t.log_p(np.full(lm.CLASSES, context), np.arange(lm.CLASSES))
        two, one = divmod(int(context), lm.CLASSES + 1)
        z = np.array([math.exp(sum((last[one, j] + before[two, j]) * q[k, j] for j in range(q.shape[1])) + b[k]) for k in range(lm.CLASSES)])
        assert abs(p.sum() - 1) < 1e-4 and np.allclose(p, z / z.sum(), rtol=1e-3)
    even = lm.train(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert np.allclose(even[0] @ even[2].T + even[3], even[3][0])


def test_language_model_learns_from_all_tokens(spark, sf, monkeypatch):
    """Where the corpus is larger than the draw, every token of it counts in the model, and the held-out score gains."""
    docs, seen, held = spark.read.parquet(f"{sf}/documents.parquet"), [], []
    real = lm.refine
    monkeypatch.setattr(lm, "DRAWS", 4000)
    for refine in (lambda *x: seen.append(real(*x)) or seen[-1], lambda rows, parts, sums: (parts, 0)):
        monkeypatch.setattr(lm, "refine", refine)
        held.append(lm.score(docs).agg(F.sum(F.when(F.col("held_out"), F.col("score"))).alias("s"), F.max("train_tokens").alias("n")).first())
    assert seen[0][1] == held[0]["n"] > 10 * lm.DRAWS and held[0]["s"] > held[1]["s"]


def test_language_model_counts_trigrams_in_one_pass(spark, sf, monkeypatch):
    """Where the corpus is larger than the draw too; the draw is one in so many tokens of each trigram, in whatever order the rows are."""
    real, begin, calls, drawn = lm._trigrams, lm.start, [], []
    monkeypatch.setattr(lm, "DRAWS", 4000)
    monkeypatch.setattr(lm, "_trigrams", lambda *x: calls.append(x) or real(*x))
    monkeypatch.setattr(lm, "start", lambda code, n: drawn.append(int(n.sum())) or begin(code, n, rounds=5))
    monkeypatch.setattr(lm, "refine", lambda rows, parts, sums: (parts, rows.agg(F.sum("n")).first()[0]))
    n = lm.score(spark.read.parquet(f"{sf}/documents.parquet")).first()["train_tokens"]
    assert len(calls) == 1 and n > 40_000 and abs(drawn[0] - n / -(-n // 4000)) < 400
    rows = spark.createDataFrame([(k * 977, k % 50 + 1) for k in range(2000)], "code long, n long")
    got = {r["code"]: r["n"] for r in lm.drawn_from(rows, 7).collect()}
    assert got == {r["code"]: r["n"] for r in lm.drawn_from(rows.repartition(5).orderBy(F.desc("code")), 7).collect()}
    assert all(0 <= got.get(k * 977, 0) - (k % 50 + 1) // 7 <= 1 for k in range(2000)) and abs(sum(got.values()) / (51_000 / 7) - 1) < 0.02
    assert sorted(map(tuple, lm.drawn_from(rows, 1).collect())) == sorted(map(tuple, rows.collect()))


def test_language_model_lookups(monkeypatch):
    """Hashes, noise, sums of trigrams and normalisers against plain ones."""
    rng = np.random.default_rng(3)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 64, 3000, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.array([2**64 - 1], np.uint64)]))
    t, place = lm.Tables(hashes, hashes, hashes, 0, 0, 0, np.zeros(0)), {int(h): k for k, h in enumerate(hashes)}
    asked = np.concatenate([hashes, hashes + np.uint64(1), np.arange(300, dtype=np.uint64)])
    assert t.look(asked).tolist() == [place.get(int(h), -1) for h in asked]
    shares = np.append(rng.random(30) ** 9, np.full(lm.CLASSES - 30, 1e-7))  # many classes between two of the places that a draw starts from
    shares, x = shares / shares.sum(), np.append(rng.random((9, 400)), [np.linspace(0, 1 - 1e-16, 400)], 0)
    assert (lm.noise_of(shares)(x) == np.minimum(np.searchsorted(np.cumsum(shares), x), lm.CLASSES - 1)).all()
    monkeypatch.setattr(lm, "HELD", 400)
    codes = rng.integers(0, 900, (12, 150)) * 1_000_003
    batches = [b for x in codes for b in lm._batches(*lm.summed(x))]
    got = [(c, n) for b in lm._merged(iter(batches)) for c, n in zip(b.column("code").to_pylist(), b.column("n").to_pylist(), strict=True)]
    assert sorted(got) == sorted(Counter(codes.ravel().tolist()).items()) and not [b for b in lm._merged(iter([])) if b.num_rows]
    x, y = rng.normal(0, 3, (40, 30)), rng.normal(0, 3, (50, 30))
    x[7], y[9] = np.arange(30) * 60.0, np.arange(30) * -61.0  # no class is likely after both: the products vanish
    z = x[None] + y[:, None]
    assert np.allclose(lm.normalisers(x, y), z.max(2) + np.log(np.exp(z - z.max(2)[..., None]).sum(2)), atol=1e-9)


def test_language_model_scores_by_hand(spark):
    """The model's score of a text is the sum over its tokens of class probability and share of the class."""
    texts = [(k, f"the cat sat on a mat and the dog ran w{k % 7} end") for k in range(60)] + [(100, "the bird sat on unseen words")]
    rows = spark.createDataFrame(texts, DOCS)
    seen = {}
    real = lm.train
    try:
        lm.train = lambda code, n: seen.setdefault("model", real(code, n))
        got = {r["doc_id"]: r for r in lm.score(rows).collect()}
    finally:
        lm.train = real
    last, before, q, b = (x.astype(float) for x in seen["model"])
    counts = Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 10 for w in t.split())
    ends = sum(zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in texts)
    kind = {}
    hashes = {w: int(lm.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in counts}
    for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], hashes[w]))):
        kind[w] = k + 1
    bucket = lambda w: int(lm.bucket(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0])
    for i, t in texts[-3:]:
        classes = [kind.get(w, bucket(w)) for w in t.split()] + [0]
        two = one = lm.START
        total = 0.0
        for k, w in zip(classes, [*t.split(), None], strict=True):
            z = (last[one] + before[two]) @ q.T + b
            total += (z[k] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
            if k >= lm.TOP:  # no counted word is left in the buckets here
                total += math.log10(lm.ALPHA) - math.log10(lm.ALPHA)
            two, one = one, k
        assert abs(got[i]["score"] - total) < 1e-2 and ends


def test_languages(spark, hard, empty):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()
    some = hard.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, "bb"))
    out = {r["doc_id"]: r for r in langid.predict(some, langid.fit(some)).collect()}
    assert out[10**6]["lang_pred"] == out[10**6 + 4]["lang_pred"] == "und" and out[10**6 + 2]["lang_pred"] in ("aa", "bb")
    none = langid.fit(empty.withColumn("lang", F.lit("x")))
    assert {r["lang_pred"] for r in langid.predict(some, none).collect()} == {"und"}


def step(p, side, x, h):
    """One step of a gated recurrent unit, gate by gate."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    g, n = x @ p[side + "w"].astype(float) + p[side + "b"], len(h)
    a = h @ p[side + "u"].astype(float)
    z, r = sig(g[:n] + a[:n]), sig(g[n : 2 * n] + a[n : 2 * n])
    new = np.tanh(g[2 * n :] + r * (a[2 * n :] + p[side + "bn"]))
    return (1 - z) * new + z * h


def test_languages_by_hand():
    """Every byte labelled by a forward pass written out; the document's probabilities are pooled over all of them."""
    model = langid.Model(["aa", "bb", "cc"])
    texts = ["", "short", "a text of more than one window, " * 8]
    raw = [t.encode() for t in texts]
    got = model.documents(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, x, probs in zip(texts, raw, got, strict=True):
        logs = []
        for lo in range(0, len(x), langid.WINDOW):
            w = x[lo : lo + langid.WINDOW]
            one = np.eye(256)
            f, b, h = [], [], np.zeros(langid.HIDDEN)
            for c in w:
                h = step(model.p, "f", one[c], h)
                f.append(h)
            h = np.zeros(langid.HIDDEN)
            for c in reversed(w):
                h = step(model.p, "b", one[c], h)
                b.insert(0, h)
            z = np.array(f) @ model.p["vf"] + np.array(b) @ model.p["vb"] + model.p["c"]
            logs += list(z - np.log(np.exp(z).sum(1, keepdims=True)))
        mean = np.mean(logs, 0) if logs else np.zeros(3)
        assert np.allclose(probs, np.exp(mean) / np.exp(mean).sum(), atol=1e-4)
        assert model.positions(t) == [model.languages[int(np.argmax(v))] for v in logs]


def test_rare_languages_are_learned(spark):
    """Of 6,000 documents 20 are in a language of their own."""
    rows = [(k, " ".join("der die das und ist nicht mit wir".split()[(k * j) % 8] for j in range(1, 30)), "de") for k in range(6000)]
    rows += [(10_000 + k, " ".join("qo xha zwe pli vux kyo".split()[(k * j) % 6] for j in range(1, 30)), "zz") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=300)
    assert model.languages == ["de", "zz"]
    assert langid.predict(docs, model).where("(doc_id >= 10000) <> (lang_pred = 'zz')").count() < 60
    assert langid.predict(docs.limit(0), model).count() == 0


def test_toxicity_by_hand(spark):
    """A text's score by a forward pass over each of its windows, written out."""
    rows = [(k, f"{'you vile awful fool' if k % 3 == 0 else 'a kind and calm letter'} number {k} " + "of plain words here " * (k % 20)) for k in range(120)]
    import pyarrow as pa

    model = toxicity.trained(pa.array([t for _, t in rows], pa.large_string()), np.array([k % 3 == 0 for k, _ in rows]))
    p = model.p
    for text in (rows[0][1], rows[19][1], "", "unseen Wörter only"):
        raw = lower(text).encode()
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)
        vectors = []
        for w in words:
            buf = np.frombuffer(w, np.uint8)
            grams, _ = toxicity.grams(buf, np.array([0]), np.array([len(w)]))
            known = np.flatnonzero(model.vocabulary == toxicity.span_hashes(buf, np.array([0]), np.array([len(w)]))[0])
            vectors.append(np.concatenate([p["words"][known[0] + 1 if len(known) else 0], p["grams"][grams].mean(0)]))
        worst = -np.inf
        for lo in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
            part = vectors[lo : lo + toxicity.WINDOW] + [np.zeros(12)] * (toxicity.WINDOW - len(vectors[lo : lo + toxicity.WINDOW]))
            n = len(vectors[lo : lo + toxicity.WINDOW])
            f, b = [], []
            h = np.zeros(toxicity.HIDDEN)
            for x in part:
                h = step(p, "f", x, h)
                f.append(h)
            h = np.zeros(toxicity.HIDDEN)
            for x in reversed(part):
                h = step(p, "b", x, h)
                b.insert(0, h)
            hidden = np.concatenate([f, b], 1)
            a = np.tanh(hidden @ p["a"]) @ p["q"]
            a[n:] = -30
            w = np.exp(a - a.max())
            worst = max(worst, float((w / w.sum()) @ hidden @ p["o"] + p["c"][0]))
        want = 1 / (1 + math.exp(-(model.scale * worst + model.shift)))
        assert abs(model.scores(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0] - want) < 1e-3


def test_added_personal_data(spark):
    """Precision and recall of the added kinds on made texts with known truths and decoys."""
    rng = np.random.default_rng(4)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    code = lambda n, signs="ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789": "".join(rng.choice(list(signs), n))
    texts, truth = [], []
    for k in range(600):
        yes = {
            "secret": lambda: (pick("api key: ", "password=", "the token is "), f"a7{code(28)}Z9"),
            "tel": lambda: (pick("call ", "phone: ", "her mobile "), f"({int(rng.integers(212, 990))}) {int(rng.integers(222, 999))}-{int(rng.integers(1000, 9999))}"),
            "ssn": lambda: (pick("SSN ", "social security number "), f"{int(rng.integers(101, 600)):03d}-{int(rng.integers(10, 99))}-{int(rng.integers(1000, 9999))}"),
            "person": lambda: (pick("signed by ", "dear ", "contact "), f"{pick('Mr', 'Mrs', 'Dr')}. {pick('John', 'Mary', 'Paul', 'Anna')} {pick('Miller', 'Okafor', 'Lindt', 'Serrano')}"),
        }
        no = {
            "secret": lambda: (pick("commit ", "sha256 ", "digest "), code(40, "0123456789abcdef")),
            "ssn": lambda: ("part number ", f"000-{int(rng.integers(10, 99))}-0000"),
            "tel": lambda: ("version ", f"{int(rng.integers(100, 199))} {int(rng.integers(100, 199))} {int(rng.integers(1000, 9999))}"),
            "person": lambda: ("the film ", pick("Dr Strangelove", "Dr Who", "Mr President")),
        }
        good = k % 2 == 0
        kind = pick(*(yes if good else no))
        lead, item = (yes if good else no)[kind]()
        texts.append((k, f"Some words stand here. {lead}{item} and more follow."))
        truth.append((kind, 23 + len(lead), 23 + len(lead) + len(item)) if good else None)
    found = {r["doc_id"]: {(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.split(":")[0] in pii.ADDED} for r in pii.spans(spark.createDataFrame(texts, DOCS)).collect()}
    hit = sum(t in found[k] for k, t in enumerate(truth) if t)
    wrong = sum(len(found[k] - {t}) for k, t in enumerate(truth))
    assert hit >= 0.9 * sum(t is not None for t in truth) and wrong <= 0.1 * hit


def test_redaction_covers_spans(spark, sf):
    """Marks stand where spans do: where none overlap the text is that with its spans replaced, and no span's text is left."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").where("text is not null")
    spans_of = {r["doc_id"]: r["spans"] for r in pii.spans(rows).collect()}
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    seen = 0
    for r in pii.redact(rows).collect():
        spans = sorted((int(a), int(e), k) for k, a, e in (x.split(":") for x in spans_of[r["doc_id"]].split(",") if x))
        if all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False)):
            out, at, text = [], 0, texts[r["doc_id"]]
            for a, e, k in spans:
                out += [text[at:a], f"[{k.upper()}]"]
                at = e
            assert r["text"] == "".join(out) + text[at:]
            seen += len(spans)
        else:
            assert not any(texts[r["doc_id"]][a:e] in r["text"] for a, e, _ in spans)
    assert seen


def gradient(f, x, k):
    old = x.flat[k]
    x.flat[k] = old + 1e-2
    up = f()
    x.flat[k] = old - 1e-2
    down = f()
    x.flat[k] = old
    return (up - down) / 2e-2


def test_recurrent_layer():
    from narratix.llm import gru

    rng = np.random.default_rng(0)
    p = gru.init(rng, 5, 4)
    steps = rng.integers(0, 5, (7, 3))
    weight = rng.normal(size=(7, 3, 4)).astype(np.float32)
    run = lambda: gru.forward((p["w"] + p["b"])[steps], p)
    h, saved = run()
    assert np.allclose(h, gru.states(p["w"] + p["b"], steps, p), atol=1e-5)
    dg, du, dbn = gru.backward(weight, saved, p)
    loss = lambda: float((run()[0] * weight).sum())
    for name, g in (("w", gru.summed(steps, dg, 5)), ("u", du), ("bn", dbn), ("b", dg.sum((0, 1)))):
        for k in rng.integers(0, p[name].size, 4):
            assert abs(gradient(loss, p[name], k) - g.flat[k]) < 2e-2


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    frames = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
        frames[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()})
    before, after = frames["near_duplicates"]
    assert set(after) == set(brute_components({k: fingerprint(t) for k, t in before.items()}).values())
    before, after = frames["decontamination"]
    bad = {x[0] for x in brute_windows(before.items(), [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]) if x[-1]}
    assert bad and set(after) == set(before) - bad
    before, after = frames["personal_data"]
    assert set(before) == set(after) and any(before[k] != after[k] for k in before)
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == len(after)


def test_pipeline_on_hard_rows(spark, sf, hard):
    """Every stage on nulls, empty and long texts, repeated rows and clashing columns, and on no rows: columns stay, and nothing crashes."""
    docs = hard.withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit(None).cast("string"))
    docs = docs.where("doc_id is null or doc_id < 40 or doc_id >= 1000000")
    for frame in (docs, docs.limit(0)):
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, sf).cache()
            assert kept.columns == before.columns and kept.count() <= before.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
        assert packed.where("start = 0").count() == kept.count()
