"""Every operator on nulls, empty and long texts, repeated rows, empty tables, and columns with clashing names."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionloom.llm import archives, contamination, fuzzy, language, lines, nearest, pieces, private, tokenfiles, toxicity
from sessionloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog " * 4000


def rows():
    texts = [None, "", " \n\t", "Ein Satz. " * 30, LONG, "x" * 60_000, "@" * 500 + "1 " * 500, "<|endoftext|> ▁▁ 日本 \x00 é", "The same line of text, twice.", "The same line of text, twice."]
    out = [(i, t, "en" if i % 2 else None, "src", len(t or "")) for i, t in enumerate(texts)]
    return [*out, (3, texts[3], "de", None, None), (None, "no id here", None, None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with odd rows and further columns named like results."""
    path = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(rows(), DOCS).withColumns({c: F.lit(7) for c in ("Score", "kept", "n_tokens", "fp", "hi", "_found", "first", "spans", "key")})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "!!"), (5, "fox"), (5, "fox")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(10)] + [(None, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "http://a/ b", "x" * 200), (2, None, "x" * 200), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", "x" * 200), (5, "u", "short"), (6, "u", "short"), (7, "ü\n", "é\r\n\r\nWARC/1.1\r\n" * 20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0]), (None, [1.0, 2.0]), (100, [])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_decontaminate", "op7_archives", "op10_nearest", "op12_variants", "op13_lexical"}))
def test_one_row_for_each_document(spark, folder, name):
    found = QUERIES[name](spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows())


def test_empty_labels(spark, folder, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = spark.read.parquet(f"{empty}/labels.parquet")
    assert toxicity.fit(none, docs) is None
    assert {r["s"] for r in docs.select(toxicity.scored(F.col("text"), None, spark).alias("s")).collect()} == {0.0}
    model = language.fit(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()} == {("und", 0.0)}


def test_language_of_nothing(spark, folder):
    found = {r["doc_id"]: r for r in language.op8_language(spark, folder).where("doc_id IS NOT NULL").collect()}
    assert [found[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3
    assert found[3]["lang_pred"] != "und"


def test_lines(spark, folder):
    found = {r["doc_id"]: r for r in lines.op2_line_dedup(spark, folder).where("doc_id IS NOT NULL").collect()}
    assert (found[0]["n_lines"], found[0]["n_dropped"], found[0]["kept_sha256"]) == (1, 0, hashlib.sha256(b"").hexdigest())
    assert found[2]["n_lines"] == 2


def test_line_stage_with_clashing_names_and_no_ids(spark, folder):
    common = [f"a line that all the rows without an id share, {i}" for i in range(3)]
    docs = spark.createDataFrame([(None, "\n".join([*common, f"own line {i}"]), i) for i in range(5)] + [(1, common[0], 9), (2, "x", 9)], "doc_id long, text string, _of int")
    docs = docs.withColumns({c: F.lit(1) for c in ("_gone", "_LINES", "_key", "order", "range", "last")})
    found = lines.stage(spark, docs, folder)
    assert found.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["_of"]) for r in found.collect()) == sorted(
        [(0, "\n".join([*common[1:], f"own line {i}"]), i) for i in range(5)] + [(1, common[0], 9), (2, "x", 9)]
    )


def test_fingerprint_of_nothing(spark, folder):
    found = fuzzy.op4_simhash(spark, folder).collect()
    blank = [r for r in found if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in blank if r["doc_id"] in (0, 1, 2)} == {0}
    twice = {r["component_id"] for r in found if r["doc_id"] in (8, 9)}
    assert twice == {8}


def test_decontamination(spark, folder):
    found = {(r["doc_id"], r["item_id"]) for r in contamination.op1_decontaminate(spark, folder).collect()}
    assert found == {(4, 1), (4, 5)}


def test_tokens(spark, folder):
    six = {r["doc_id"]: r for r in pieces.op6_pieces(spark, folder).where("doc_id IS NOT NULL").collect()}
    assert [six[i]["n_tokens"] for i in (0, 1)] == [1, 1]
    five = sorted((r["start"], r["n_tokens"]) for r in tokenfiles.op5_tokenfiles(spark, folder).collect())
    assert five[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(five, five[1:]))


def test_archives(spark, folder):
    found = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archives.op7_archives(spark, folder).collect()), key=str)
    assert found == sorted(
        [(0, 200, "revisit", 1), (1, 200, "response", None), (2, 200, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (7, 320, "response", None)],
        key=str,
    )


def test_archives_of_bytes(spark, tmp_path):
    """Payloads that aren't text, Latin-1 heads, blanks in a url, a page named like a version block, equal records."""
    image = bytes(range(256))
    contents = [b"HTTP/1.0 200 OK\r\nX-Page-Id: %d\r\nServer: caf\xe9\r\nContent-Length: %d\r\n\r\n" % (i, len(p)) + p for i, p in ((1, image), (2, image), (2, image), (3, b"\xff\n"))]
    urls = ["http://a/one two", "filedesc://page", "filedesc://page", "http://c/"]
    lines = [f"{u} 0.0.0.0 {archives.DATE} image/png {len(c)}\n".encode() + c + b"\n" for u, c in zip(urls, contents, strict=True)]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(archives.arc_head(1, "a") + b"".join(lines)))
    archives.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    found = sorted((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in archives.read_warc(spark, str(tmp_path / "warc")).collect())
    assert found == [
        (1, "http://a/one%20two", 256, "response", None, image),
        (2, "filedesc://page", 256, "revisit", 1, b""),
        (2, "filedesc://page", 256, "revisit", 1, b""),
        (3, "http://c/", 2, "response", None, b"\xff\n"),
    ]
    heads = [f for file in (tmp_path / "warc").glob("*.gz") for f, _ in archives.warc_records(gzip.decompress(file.read_bytes()))]
    assert len({f["WARC-Record-ID"] for f in heads}) == 4
    first = [f["WARC-Record-ID"] for f in heads if f["WARC-Target-URI"].endswith("one%20two")]
    assert {f["WARC-Refers-To"] for f in heads if f["WARC-Type"] == "revisit"} == set(first)


def test_arc_offsets_count_bytes():
    head = archives.arc_head(2, "n")
    one = archives.arc_record(2, 1, "u", "é" * 9, "n", len(head))
    raw = head + one + archives.arc_record(2, 2, "v", "x", "n", len(head + one))
    assert all(raw[int(f["Offset"]) :].startswith(f["URL"].encode()) for _, f, _ in archives.arc_records(raw))


def test_stages_keep_clashing_columns(spark, folder):
    docs = spark.createDataFrame([(1, "Ein Satz mit Worten.", "de", "s", 20), (2, "Some words of another text.", "en", "s", 27)], DOCS)
    docs = docs.withColumns({c: F.lit(5) for c in ("_row", "_HITS", "_found_language", "_lines")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, docs.collect())), name


def test_vectors(spark, folder):
    found = {}
    for r in nearest.op10_nearest(spark, folder).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {0: [6, 7, 50], 50: [6, 7, 0]}


def test_private_long_runs(spark):
    field = private.train([], generate=60, rounds=2)
    assert private.spans(None, field) == ([], [])
    assert private.spans("1" * 50_000 + "@" + "a" * 50_000, field)[0] == []


def test_pipeline_keeps_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, folder).count() >= 3


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
