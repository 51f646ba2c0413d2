"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from etalage.llm import ngram_join
from etalage.llm import queries as llm
from etalage.llm.html import extract_text
from etalage.llm.licenses import BANDS, LIKENESS, NOTICES, collision_probability, license_scan
from etalage.llm.mixing import mix_sources
from etalage.llm.ngram_join import ngram_jaccard_join
from etalage.llm.packing import pack
from etalage.llm.quality import keep_quality, quality_scores
from etalage.llm.tokens import VOCABULARY, PieceCounter, token_counts, vocabulary
from etalage.llm.topk import top_k
from etalage.llm.toxicity import toxicity_scores
from etalage.llm.vector_dedup import audit_recall, vector_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Null and empty texts, one word, a repeated row, a null id, and a long text.
EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "word", None, "a", 4), (4, " \n\t ", "en", "b", 4),
    (5, "one two three four five six", "en", "a", 27), (5, "one two three four five six", "en", "a", 27),
    (None, "one two three four five six", "xx", "b", 27), (6, "One TWO three four five six", "en", "b", 27), (7, "long text " * 20_000, "en", "a", 200_000),
]


@pytest.fixture(scope="module")
def edges(spark):
    # extra columns, one of which has a name that the operators use themselves
    return spark.createDataFrame(EDGES, DOCS).withColumn("score", F.lit("x")).withColumn("n", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, None), (5, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def _linked(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {}
    for doc, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[doc] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in sets}


def test_join_equals_brute_force(spark, edges):
    chance = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts: dict[int, str | None] = {}
    for family in range(12):
        base = [chance.choice(words) for _ in range(chance.choice([3, 7, 40, 120]))]
        for _ in range(chance.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(chance.choice([0, 0, 1, 2])):
                copy[chance.randrange(len(copy))] = chance.choice(words)
            texts[len(texts)] = " ".join(copy)
    texts[len(texts)] = None
    got = ngram_jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == _linked(texts)
    found = ngram_jaccard_join(edges).collect()
    assert len(found) == len(EDGES)
    assert {r.component_id for r in found if r.doc_id in (5, 6)} == {5}
    assert {(r.n_shingles, r.component_id) for r in found if r.doc_id in (1, 2, 4)} == {(0, 1), (0, 2), (0, 4)}
    assert ngram_jaccard_join(edges.limit(0)).count() == 0


def test_join_with_a_null_id_before_its_copies(spark):
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    docs = spark.createDataFrame([(None, text), (1, text), (2, near)], "doc_id bigint, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(docs).collect()} == {None: None} | _linked({1: text, 2: near}) == {None: None, 1: 1, 2: 1}


def test_members_far_from_each_other_do_not_meet_in_what_their_family_shares(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_COUNT", 5)
    chance = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    texts: dict[int, str | None] = {}
    for k in range(60):  # every third one is near the base, the others have 30 words of their own in a row
        at, own = chance.randrange(170), 2 if k % 3 == 0 else 30
        texts[k] = " ".join([*base[:at], *(f"own{k}x{x}" for x in range(own)), *base[at + own :]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(2)
    common = ngram_join.common_shingles(docs, 5)
    assert len(common) > 150
    rows = ngram_join._prefixes(docs, 5, 80, common).selectExpr("doc_id", "n", "posexplode(prefix) as (i, token)")
    others = rows.selectExpr("doc_id as other", "n as m", "i as j", "token")
    met = rows.join(others, "token").where("doc_id < other and (doc_id % 3 > 0 or other % 3 > 0)")
    assert met.count() > 100 and met.where(ngram_join._may_meet(80)).count() == 0
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(docs).collect()} == _linked(texts)


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    chance = np.random.RandomState(3)
    for size, changed in ((1, 1), (30, 4), (500, 90), (5000, 0)):
        left = np.unique(chance.randint(0, 2**63, size).astype(np.uint64))
        right = np.unique(np.concatenate([left[changed:], chance.randint(0, 2**63, changed).astype(np.uint64)]))
        for bits in (256, ngram_join.SKETCH_BITS):
            differ = int(np.unpackbits((ngram_join._sketch(left, bits) ^ ngram_join._sketch(right, bits)).view(np.uint8)).sum())
            assert differ <= len(np.setxor1d(left, right)) and bool(differ) == bool(changed)


def test_license_scan(spark, edges):
    assert collision_probability(LIKENESS, BANDS) > 0.999
    rows = [(k, f"some words before it. {text} and words after it") for k, (_, text) in enumerate(NOTICES)] + [(99, "licensed under nothing at all, see the apache helicopter")]
    found = license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.template) for r in found} >= {(k, k) for k in range(len(NOTICES))}
    assert 99 not in {r.doc_id for r in found}
    assert license_scan(edges).count() == 0 and license_scan(edges.limit(0)).count() == 0


def test_packing_is_a_round_trip(spark, edges):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["It's AÉ ÀÇ ’t 12x", "a  b\n\nc", None, "ﬁn İ ΑΣ x" * 3000, "don't. (yes)!'s"])], "doc_id bigint, text string")
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        pieces = pack(frame).collect()
        assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
        for row in frame.collect():
            ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [2]
            own = sorted((p for p in pieces if p.doc_id == row.doc_id), key=lambda p: p.start)
            assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
            for p in own:
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        sums: dict[int, int] = {}
        for p in pieces:
            sums[p.sequence_id] = sums.get(p.sequence_id, 0) + p.length
        assert max(sums.values()) <= 4096 and sum(s < 4096 for s in sums.values()) <= 1
    assert pack(edges).select(F.sum("length")).first()[0] > 0
    assert pack(edges.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, edges):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = vocabulary(public_tokenizers.path(VOCABULARY))
    least = min(s for _, s in pieces)
    model = models.Unigram([("<unk>", least), *pieces, *((f"<0x{k:02X}>", least) for k in range(256))], unk_id=0, byte_fallback=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    counter = PieceCounter(pieces)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", " ", "  a  b ", "日本語 \n😀x", "▁x ▁"]
    assert [counter.text(t)[1] for t in texts] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert {r.doc_id: r.n_tokens for r in token_counts(edges).collect()}[1] == 0


def test_mixing_keeps_every_row_and_its_window(spark, edges):
    rows = [(k, "abc"[min(k % 7, 2)]) for k in range(3000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string"), {"a": 0.2, "b": 0.3, "c": 0.5}, block_rows=4, period=100, bucket_rows=500).collect()
    assert len(got) == 3000 and len({(r.slot, r.place) for r in got}) == 3000
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert mix_sources(edges).count() == len(EDGES) and mix_sources(edges.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mix_sources(edges, period=1).count()


def test_mixing_keeps_exact_weights(spark):
    weights = {"s0": 0.5} | {f"s{k}": 0.0004 for k in range(1, 1251)} | {"none": 0.0}
    docs = spark.range(6000).selectExpr("id AS doc_id", "'s0' AS source").union(spark.range(6000, 12000).selectExpr("id", "concat('s', 1 + id % 1250)")).union(spark.range(12000, 12050).selectExpr("id", "'none'"))
    got = mix_sources(docs, weights, block_rows=1).collect()
    assert len(got) == len({(r.slot, r.place) for r in got}) == 12050
    slots = {s: sorted(r.slot for r in got if r.source == s) for s in ("s0", "s1", "s700", "none")}
    for source in ("s0", "s1", "s700"):
        assert all(abs(n - slot * weights[source]) < 2 and abs(n + 1 - (slot + 1) * weights[source]) < 2 for n, slot in enumerate(slots[source]))
    assert slots["none"][0] > max(r.slot for r in got if r.source != "none")
    assert all(r.release == r.block * 2 and r.deadline == r.block * 2 + 2 for r in got if r.source == "s0")


def test_top_k_equals_brute_force(spark):
    vectors = np.random.RandomState(3).randn(400, 8).round(1)
    vectors[50:80] = vectors[50]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(table, table.where("vec_id % 50 = 0"), pivots=6).collect()}
    whole = np.floor(256 * vectors.astype(np.float32).astype(float)).astype(int)
    for query in range(0, 400, 50):
        score = whole @ whole[query]
        best = [k for k in np.lexsort((np.arange(400), -score)) if k != query][:5]
        assert [got[query, n] for n in range(1, 6)] == [(k, score[k]) for k in best]
    assert len(got) == 40 and top_k(table.limit(0), table).count() == 0


def test_top_k_with_repeated_ids(spark):
    # all of one length, as data of another length is away from the query that it equals
    vectors = 1.0 - 2 * ((np.random.RandomState(6).permutation(256)[:40, None] >> np.arange(8)) & 1)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    many = table
    for _ in range(6):
        many = many.union(table)
    whole = np.floor(256 * vectors.astype(np.float32).astype(float)).astype(int)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(many, table, pivots=40).collect()}
    for query in range(40):
        score = whole @ whole[query]
        best = [k for k in np.lexsort((np.arange(40), -score)) if k != query]
        assert [got[query, n] for n in range(1, 6)] == [(best[0], score[best[0]])] * 5


def test_vector_dedup_recall(spark):
    chance = np.random.RandomState(4)
    base = chance.randn(200, 16)
    near = base[chance.randint(0, 40, 300)] + 0.05 * chance.randn(300, 16)
    vectors = np.concatenate([base, near, base[:5], base[:5]])
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 16), (902, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    result = vector_dedup(table).cache()
    found, there = audit_recall(table, result, every=1)
    assert there > 1000 and found >= 0.9 * there
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    assert all(r.n_links <= links[r.vec_id] for r in result.collect() if r.vec_id < 900)
    assert {(r.n_links, r.component_id, r.kept) for r in result.collect() if r.vec_id == 901} == {(0, 901, True)}
    assert vector_dedup(table.limit(0)).count() == 0


def test_classifiers_on_edges(spark, edges, labels):
    scores = toxicity_scores(edges, labels).collect()
    assert len(scores) == len(EDGES) and all(0 <= r.score <= 1 for r in scores)
    quality = quality_scores(edges, labels).collect()
    assert len(quality) == len(EDGES) and {r.kept for r in quality if r.doc_id in (1, 2)} == {False}
    assert keep_quality(edges, labels).columns == edges.columns
    assert toxicity_scores(edges.limit(0), labels).count() == 0 and quality_scores(edges, labels.limit(0)).count() == len(EDGES)


def test_labelled_sample_is_scanned_by_all_tasks(spark, monkeypatch):
    from etalage.llm import toxicity

    seen, write = {}, toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, purpose: seen.update({purpose: df.rdd.getNumPartitions()}) or write(df, purpose))
    docs = spark.range(0, 60, 1, 12).selectExpr("id AS doc_id", "concat('some text ', id) AS text")
    toxicity._trained(docs, docs.selectExpr("doc_id", "0 AS toxic"), 100)
    assert seen["sample"] == 12


def test_held_out_toxicity_and_quality(spark):
    sf = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf}/labels.parquet")
    held = llm.op4_toxicity(spark, sf).where("held_out").join(known, "doc_id")
    wrong = held.where("predicted = 1 and toxic = 0").count()
    caught = held.where("predicted = 1 and toxic = 1").count()
    assert caught >= 0.75 * held.where("toxic = 1").count() and wrong <= 0.1 * caught
    scored = llm.op5_quality_classifier(spark, sf).join(known, "doc_id")
    assert scored.where("kept and quality = 1").count() >= 0.98 * scored.where("quality = 1").count()
    assert scored.where("kept and quality = 0").count() <= 0.3 * scored.where("quality = 0").count()


def test_quality_knows_word_order_and_every_script(spark):
    chance = random.Random(8)
    rows = []
    for lang, letters in (("en", "abdeginorst"), ("ru", "абвгдеийнорст")):
        # all words begin and end alike, so the order shows in no few letters
        words = sorted({letters[:2] + chance.choice(letters) + chance.choice(letters) + letters[:2] for _ in range(60)})
        follow = {w: chance.sample(words, 2) for w in words}
        for k in range(150):
            text = [chance.choice(words)]
            while len(text) < 120:
                text.append(chance.choice(follow[text[-1]]))
            if k >= 120:  # the same words in another order
                chance.shuffle(text)
            rows.append((len(rows), " ".join(text), lang, k < 120))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, clean boolean")
    labels = docs.where("clean and doc_id % 3 > 0").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    got = quality_scores(docs, labels).join(docs, "doc_id").collect()
    for lang in ("en", "ru"):
        rows = [r.kept for r in got if r[1] == lang and r.clean], [r.kept for r in got if r[1] == lang and not r.clean]
        assert sum(rows[0]) >= 0.9 * len(rows[0]) == 108 and sum(rows[1]) == 0


def test_html_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    layout = """<body><div id="header"><a href=x>Home</a></div><div class="sidebar"><ul><li><a>One</a><li><a>Two</a></ul></div><div id="content"><h2>A title</h2>
        <p>The first paragraph &amp; its text, which goes on for a while.</p></div><div class="comments"><p>Nice article, thanks for writing it!</p></div>
        <form><button>Send</button></form><script>var x="<p>no</p>"</script><div id=footer>&copy; Company"""
    more = spark.createDataFrame([(9001, "u", layout), (9002, None, None), (9003, "", ""), (None, "u", "<p")], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages.unionByName(more).withColumn("text", F.lit("x"))).collect()}
    assert got[9001] == "A title\n\nThe first paragraph & its text, which goes on for a while."
    assert got[9002] == got[9003] == got[None] == ""
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.DOTALL)[1].replace("<br>", " ")
        import html

        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[row.page_id] == "\n\n".join(x for x in parts if x)


def test_packing_follows_the_mixture(spark, tmp_path):
    import corpus_pipeline

    # later files are larger, and larger files are read first
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), int(20 + id)) AS text")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "mixed"))
    read = spark.read.parquet(str(tmp_path / "mixed"))
    for frame in (read, read.limit(400)):
        assert {r.doc_id for r in pack(frame, window=256, in_file_order=True).collect()} == set(range(400))
    files = {r.doc_id: int(r.f.split("-")[1]) for r in read.select("doc_id", F.col("_metadata.file_name").alias("f")).collect()}
    for packed in (corpus_pipeline.packing(spark, read, SF), pack(read, window=64, open_windows=2, in_file_order=True)):
        pieces = [(p.sequence_id < 1 << 62, p.sequence_id, p.offset, files[p.doc_id]) for p in packed.collect()]
        for closed in {p[0] for p in pieces}:
            along = [p[-1] for p in sorted(pieces) if p[0] == closed]
            assert len(set(along)) > 3 and along == sorted(along)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert kept.count() == docs.count() if name == "mixing" else kept.count() <= docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    roots = _linked(texts)
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert left == {d for d, r in roots.items() if d == r}


def test_tags_that_never_end_take_linear_time():
    import time

    from etalage.llm.html import blocks

    started = time.monotonic()
    assert "".join(blocks('<b x="1' * 20_000 + "'>")[0].text.split()).startswith("<bx=")
    assert [b.text for b in blocks("<!" * 20_000)] == ["<!" * 20_000]
    assert [b.text for b in blocks('<p title="a > b">one</p><!-- <p>no</p> --><p>two < three</p><p>four</p><p')] == ["one", "two < three", "four"]
    assert time.monotonic() - started < 5
