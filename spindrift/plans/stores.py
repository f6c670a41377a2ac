"""Queries of sources, sinks and derived stores (S), and of what is left of the lab and repairs (V, A, J, D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import analytics as A
from ..operators import repair
from ..operators import retrieval as R
from ..operators.clusters import clusters
from ..operators.index import bm25, stored
from ..operators.kept import KeptIndex
from ..operators.knn import knn
from ..operators.metric import similar_classes
from ..operators.models import embed_text
from ..sources import blobs, events, exif, files, segments, shared, snapshots
from .registry import query
from .retrieval import _ADJ, _LANES, _OVERLAP, _QUERY, _THREE, adjusted, dense_lane, sparse_lane
from .views import active, images, searches, sql, table, vectors


def _folder(spark, name: str) -> str:
    return shared.place(spark, name)


@query("s12_postings_table", sql("vectors", _LANES + " SELECT id, term, tf FROM post WHERE term IN ('there', 'erent', 'with')"))
def postings_table(spark, d):
    """The inverted index as a table: written once, then read by term."""
    index = stored(spark, f"{d}/documents.parquet", "doc_id", "text")
    return index.postings.where(F.col("term").isin("there", "erent", "with")).select("id", "term", "tf")


@query(
    "s12_index_kept",
    sql(
        "vectors",
        _LANES
        + """ SELECT term, count(*) AS df, sum(tf) AS tf, round(any_value(idf), 6) AS idf, CAST(sum(dl) AS BIGINT) AS lengths
FROM post JOIN idf USING (term) GROUP BY term""",
    ),
)
def index_kept(spark, d):
    """An index that began with other texts, fewer and more documents, and was changed into that of the table, segment by segment."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    first = docs.where("id % 5 <> 0").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("draft of "), F.reverse("text"))).otherwise(F.col("text")))
    strange = docs.where("id % 50 = 7").select((-1 - F.col("id")).alias("id"), "text")
    kept = KeptIndex(spark, _folder(spark, "index")).changed(first.union(strange))
    kept.changed(docs.where("id % 5 = 0"), strange.select("id"))
    index = kept.changed(docs.where("id % 3 = 0")).index()
    lengths = index.postings.groupBy("term").agg(F.sum("dl").alias("lengths"))
    return index.terms.join(lengths, "term").select("term", "df", "tf", F.round("idf", 6).alias("idf"), "lengths")


@query("s12_search_kept", sql("vectors", _LANES + " SELECT id, round(score, 6) AS score, rank FROM sparse"))
def search_kept(spark, d):
    """The sparse lane on an index that was loaded in two halves and opened again from its folder."""
    docs, where = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _folder(spark, "index")
    KeptIndex(spark, where).changed(docs.where("id % 2 = 0")).changed(docs.where("id % 2 = 1"))
    q = spark.createDataFrame([(0, _QUERY)], "query_id long, text string")
    index, _ = KeptIndex(spark, where).index_or_empty()
    return bm25(index, q, V.SPARSE_K).select("id", F.round("score", 6).alias("score"), "rank")


@query("s13_event_sink", sql("searches", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS dt, count(*) AS n FROM searches GROUP BY 1"))
def event_sink(spark, d):
    """Events written as gzip JSON by day, twice; equal ids count once."""
    where = _folder(spark, "events")
    e = searches(spark, d).select("id", "created_at", "search_kind", "user_id", "result_count", "top_score", F.lit(0).alias("version"))
    events.write(e, where)
    events.write(e.where("id % 10 = 0").withColumn("version", F.lit(1)), where)
    return events.read(spark, where).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"))


@query("s14_event_scan", sql("searches", "SELECT id, result_count FROM searches WHERE created_at BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:00:00'"))
def event_scan(spark, d):
    where = _folder(spark, "events")
    events.write(searches(spark, d).select("id", "created_at", "search_kind", "user_id", "result_count", "top_score", F.lit(0).alias("version")), where)
    return events.read(spark, where, "2024-01-05 06:00:00", "2024-01-09 18:00:00").select("id", "result_count")


@query("s15_event_lookup", sql("searches", "SELECT id, search_kind FROM searches WHERE id % 97 = 0"))
def event_lookup(spark, d):
    where = _folder(spark, "events")
    s = searches(spark, d)
    events.write(s.select("id", "created_at", "search_kind", "user_id", "result_count", "top_score", F.lit(0).alias("version")), where)
    wanted = s.where("id % 97 = 0").select("id")
    return events.lookup(spark, where, s.select("id", F.to_date("created_at").alias("dt")), wanted).select("id", "search_kind")


_DECKS = """, t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_replace(regexp_replace(coalesce(text, ''), '[^ -~]', ' ', 'g'), ' +', ' ', 'g') AS x FROM conversations), w AS (SELECT *, trim(left(x, 30)) AS head, trim(substring(x, 31)) AS rest FROM t)"""


def _decks(spark, d):
    """Conversations as presentations in the shared folder: a slide and a picture for each turn."""
    from ..sources import pptx

    where = _folder(spark, "decks")
    x = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", " "), " +", " ")
    slide = F.struct("turn", F.trim(F.left(x, F.lit(30))).alias("title"), F.trim(F.expr("substring(regexp_replace(regexp_replace(coalesce(text, ''), '[^ -~]', ' '), ' +', ' '), 31)")).alias("body"), "role")
    decks = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(slide)).alias("slides"))

    def write(batches):
        import pandas as pd

        for b in batches:
            out = [(f"{r.conv_id % 8}/deck{r.conv_id}.pptx", pptx.written([{"title": s["title"], "body": s["body"], "notes": s["role"], "pictures": [f"{r.conv_id}-{s['turn']}".encode()]} for s in r.slides], f"author {r.conv_id % 3}")) for r in b.itertuples()]
            yield pd.DataFrame(out, columns=["key", "content"])

    blobs.put(decks.mapInPandas(write, "key string, content binary"), where).count()
    return files.corpus(spark, where)


def _id():
    return F.regexp_extract("path", "deck(-?[0-9]+)[.]pptx$", 1).cast("long").alias("conv_id")


@query("s01_corpus_scan", "SELECT conv_id, 'pptx' AS suffix, 'pptx' AS kind FROM conversations GROUP BY conv_id")
def corpus_scan(spark, d):
    """The supported files below a folder, and the extractor that each goes to (S01, S02)."""
    return _decks(spark, d).select(_id(), "suffix", files.kind(F.col("suffix")).alias("kind"))


@query("s03_pptx_pictures", "WITH " + _DECKS[2:] + " SELECT conv_id, n AS slide_index, CASE WHEN head <> '' THEN head WHEN rest <> '' THEN rest END AS title, role AS notes, 'author ' || conv_id % 3 AS author, sha256(conv_id || '-' || turn) AS digest FROM w JOIN conversations USING (conv_id, turn)")
def pptx_pictures(spark, d):
    found = files.extracted(_decks(spark, d))
    return found.select(_id(), "slide_index", "title", "notes", "author", F.sha2("picture", 256).alias("digest"))


@query("s04_slide_texts", "WITH " + _DECKS[2:] + " SELECT conv_id, n AS slide_index, CASE WHEN head <> '' THEN head WHEN rest <> '' THEN rest END AS title, CASE WHEN head = '' OR rest = '' OR rest = head THEN NULL WHEN length(rest) <= 1500 THEN rest ELSE trim(left(rest, 1497)) || '...' END AS body FROM w")
def slide_texts(spark, d):
    return files.slide_texts(_decks(spark, d)).select(_id(), "slide_index", "title", "body")


def _photograph(form: int, artist: str, taken: str) -> bytes:
    """A photograph without pixels: a JPEG with its block in either order of bytes, a TIFF, or a PNG, which has no such block."""
    import struct

    if form == 3:
        return b"\x89PNG\r\n\x1a\n" + artist.encode()
    order = ">" if form == 1 else "<"
    name, at = artist.encode() + b"\0", taken.encode() + b"\0"
    head = (b"MM" if form == 1 else b"II") + struct.pack(order + "HI", 42, 8)
    body = len(head) + 2 + 2 * 12 + 4
    first = struct.pack(order + "HHHIIHHIII", 2, exif.ARTIST, exif.ASCII, len(name), body, exif.EXIF_BLOCK, exif.LONG, 1, body + len(name), 0)
    second = struct.pack(order + "HHHIII", 1, exif.TAKEN, exif.ASCII, len(at), body + len(name) + 18, 0)
    tiff = head + first + name + second + at
    block = b"Exif\0\0" + tiff
    return tiff if form == 2 else b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xd9"


@query(
    "s07_photographs",
    """SELECT conv_id, (['jpg', 'jpeg', 'tiff', 'png'])[conv_id % 4 + 1] AS suffix, CASE WHEN conv_id % 4 < 3 THEN 'author ' || conv_id % 7 END AS author,
  CASE WHEN conv_id % 4 < 3 THEN TIMESTAMP '2020-01-01' + to_hours(CAST(conv_id AS INTEGER)) END AS created_at FROM conversations GROUP BY conv_id""",
)
def photographs(spark, d):
    """A photograph for each conversation in four formats, read back by the corpus scan: who took it and when, where its block says so."""
    where = _folder(spark, "photographs")
    i = F.col("conv_id")
    taken = F.date_format(F.timestamp_seconds(F.lit(1577836800) + i * 3600), "yyyy:MM:dd HH:mm:ss")
    rows = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.concat(F.lit("author "), (i % 7).cast("string")).alias("artist"), taken.alias("taken"))

    def write(batches):
        import pandas as pd

        for b in batches:
            out = [(f"{r.conv_id % 8}/photo{r.conv_id}.{('jpg', 'jpeg', 'tiff', 'png')[r.conv_id % 4]}", _photograph(r.conv_id % 4, r.artist, r.taken)) for r in b.itertuples()]
            yield pd.DataFrame(out, columns=["key", "content"])

    blobs.put(rows.mapInPandas(write, "key string, content binary"), where).count()
    found = files.extracted(files.corpus(spark, where))
    return found.select(
        F.regexp_extract("path", "photo(-?[0-9]+)[.][a-z]+$", 1).cast("long").alias("conv_id"),
        F.regexp_extract("path", "[.]([a-z]+)$", 1).alias("suffix"),
        "author",
        F.when(F.col("dated"), F.col("created_at")).cast("timestamp_ntz").alias("created_at"),  # without a time of its own, that of the file
    )


@query("s17_blobs", sql("images", "SELECT image_id, CASE WHEN image_id % 4 = 3 THEN NULL ELSE sha256(source || image_id) END AS digest, image_id % 4 = 1 AS again FROM images"))
def blobs_(spark, d):
    """Blobs put by key, every fourth put again, every fourth deleted; what is left, by key."""
    where = _folder(spark, "blobs")
    i = images(spark, d).select("image_id", F.concat(F.lit("objects/"), F.pmod("image_id", F.lit(16)).cast("string"), F.lit("/"), F.col("image_id").cast("string")).alias("key"), F.concat("source", F.col("image_id").cast("string")).alias("content"))
    blobs.put(i, where).count()
    blobs.put(i.where("image_id % 4 = 1"), where).count()
    blobs.delete(i.where("image_id % 4 = 3"), where).count()
    there = blobs.listing(spark, where).select("key")
    got = blobs.get(i, where).select("key", F.sha2("content", 256).alias("digest"))
    return i.join(got, "key").join(there.withColumn("there", F.lit(True)), "key", "left").select("image_id", F.when(F.col("there"), F.col("digest")).alias("digest"), (F.col("image_id") % 4 == 1).alias("again"))


@query("s18_snapshot", sql("images", "SELECT image_id, source FROM images"))
def snapshot(spark, d):
    """Tables copied with a manifest, checked and read back."""
    where = _folder(spark, "snapshot")
    snapshots.snapshot({"images": images(spark, d).select("image_id", "source"), "vectors": vectors(spark, d)}, where, "one", "2024-01-01")
    return snapshots.restore(spark, where, "one")["images"]


@query(
    "s19_snapshot_choice",
    """WITH n AS (SELECT count(*) AS whole, count(*) FILTER (c_custkey % 2 = 0) AS half, count(*) FILTER (c_custkey % 10 = 0) AS tenth FROM customer)
SELECT label, row_number() OVER (ORDER BY label <> 'checkpoint-latest', day DESC) AS rank
FROM n, (VALUES ('a', 1), ('b', 2), ('c', 3), ('checkpoint-latest', 0)) v(label, day)
WHERE CASE label WHEN 'a' THEN whole WHEN 'c' THEN tenth ELSE half END > tenth""",
)
def snapshot_choice(spark, d):
    """Snapshots of more rows than a tenth of the table, which is what is here: the rolling one first, then the newest."""
    where, c = _folder(spark, "choice"), table(spark, d, "customer")
    tenth = c.where("c_custkey % 10 = 0")
    for label, at, rows in (("checkpoint-latest", "2024-01-00", c.where("c_custkey % 2 = 0")), ("a", "2024-01-01", c), ("b", "2024-01-02", c.where("c_custkey % 2 = 0")), ("c", "2024-01-03", tenth)):
        snapshots.snapshot({"customer": rows}, where, label, at)
    found = snapshots.choice(spark, where, tenth.count())
    return found.select("label", F.row_number().over(Window.orderBy((F.col("label") == snapshots.LATEST).desc(), F.col("at").desc())).alias("rank"))


@query("s19_restore_falls_through", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def restore_falls_through(spark, d):
    """The newest snapshot and the rolling one lose a chunk, so the one before them comes back."""
    where, c = _folder(spark, "fall"), table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    for label, at, rows in (("one", "2024-01-01", c.where("c_custkey % 2 = 0")), ("two", "2024-01-02", c), (snapshots.LATEST, "2024-01-03", c)):
        snapshots.snapshot({"customer": rows}, where, label, at)
    newest = segments.told(spark, f"{where}/manifests", "two.json")["tables"]["customer"]["chunks"]
    older = {x["content"] for x in segments.told(spark, f"{where}/manifests", "one.json")["tables"]["customer"]["chunks"]}
    lost = next(x for x in newest if x["content"] not in older)
    segments.removed(spark, f"{where}/objects/customer/{lost['at']}/_content={lost['content']}")
    return snapshots.restore_best(spark, where)[1]["customer"]


@query("s21_slide_cache", "WITH c AS (SELECT sha256(text) AS h, arg_max(conv_id, (conv_id, turn)) AS result FROM conversations WHERE turn = 0 GROUP BY 1) SELECT conv_id, turn, coalesce(CAST(result AS VARCHAR), 'miss') AS result FROM conversations LEFT JOIN c ON sha256(text) = h")
def slide_cache(spark, d):
    c = table(spark, d, "conversations").withColumn("h", F.sha2("text", 256))
    cache = c.where("turn = 0").select("h", F.col("conv_id").cast("string").alias("result"), F.struct("conv_id", "turn").alias("at"))
    return snapshots.cached(c.select("conv_id", "turn", "h"), cache, "h", F.lit("miss")).select("conv_id", "turn", "result")


@query("s23_report_sink", sql("images", "SELECT source_type, count(*) AS n FROM images GROUP BY 1"))
def report_sink(spark, d):
    where = _folder(spark, "report")
    images(spark, d).groupBy("source_type").agg(F.count("*").alias("n")).write.json(where)
    return spark.read.schema("source_type string, n long").json(where)


@query("s28_source_keys", sql("images", "SELECT DISTINCT source_file, 'uploads/' || left(sha256(source_file), 2) || '/' || sha256(source_file) || '/' || regexp_extract(source_file, '[^/]+$') AS key FROM images"))
def source_keys(spark, d):
    """Content-addressed places that keep the original name."""
    s = images(spark, d).select("source_file").distinct()
    h = F.sha2("source_file", 256)
    return s.select("source_file", F.concat(F.lit("uploads/"), F.left(h, F.lit(2)), F.lit("/"), h, F.lit("/"), T.safe_filename("source_file")).alias("key"))


@query("v25_lab_single_lane", sql("vectors", _LANES + " SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM sparse WHERE score > 0 QUALIFY rank <= 20"))
def single_lane(spark, d):
    return R.ranked(sparse_lane(spark, d).where("score > 0").drop("rank"), 20).select("id", "rank")


@query("v26_lab_hubness_refused", sql("vectors", _ADJ + ", raw AS (SELECT image_id AS id, list_cosine_similarity(vector, (SELECT vector FROM vectors WHERE image_id = 0)) AS score FROM vectors), dense AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM raw QUALIFY rank <= 50) SELECT id, rank, round(adj.score, 6) AS score FROM dense JOIN adj USING (id)"))
def hubness_refused(spark, d):
    """Scores adjusted for hubness, ranks as before: the lane isn't sorted again."""
    return adjusted(spark, d, dense_lane(spark, d)).select("id", "rank", F.round("score", 6).alias("score"))


@query("v27_lab_three_lanes", sql("vectors", _THREE + ", f AS (SELECT id, sum(1e0 / (60 + rank)) AS fused FROM (SELECT id, rank FROM dense UNION ALL SELECT id, rank FROM text UNION ALL SELECT id, rank FROM sparse) GROUP BY id) SELECT id, round(least(1e0, fused / (3e0 / 61)), 6) AS score FROM f"))
def three_lanes(spark, d):
    f = R.rrf([("dense", dense_lane(spark, d), 1.0), ("text", dense_lane(spark, d, 50, 9), 1.0), ("sparse", sparse_lane(spark, d), 1.0)])
    return f.select("id", F.round(R.rrf_normalised(F.col("fused"), F.col("weight_sum")), 6).alias("score"))


@query("v28_lab_filter_then_fuse", sql("vectors", _LANES + f", o AS (SELECT doc_id AS id FROM documents WHERE {_OVERLAP} >= 0.25e0), f AS (SELECT id, sum(1e0 / (60 + rank)) AS fused FROM (SELECT id, rank FROM dense UNION ALL SELECT id, rank FROM sparse) GROUP BY id), k AS (SELECT * FROM f WHERE id IN (FROM o)) SELECT id, row_number() OVER (ORDER BY round(fused, 9) DESC, id) AS rank FROM (SELECT * FROM k UNION ALL SELECT * FROM f WHERE NOT EXISTS (FROM k)) QUALIFY rank <= 20"))
def filter_then_fuse(spark, d):
    """Candidates that the model scores 0.25 or more, all if none is, in fused order."""
    from ..operators.models import overlap_score

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), overlap_score(F.lit(_QUERY), F.col("text")).alias("model"))
    f = R.rrf([("dense", dense_lane(spark, d), 1.0), ("sparse", sparse_lane(spark, d), 1.0)]).join(docs, "id", "left")
    passes = F.coalesce(F.col("model") >= V.WEAK_SCORE, F.lit(False))
    some = F.max(passes).over(Window.partitionBy("query_id"))
    kept = f.withColumn("_p", passes).withColumn("_s", some).where("_p or not _s")
    return R.ranked(kept.withColumn("score", F.col("fused")).select("query_id", "id", "score"), 20).select("id", "rank")


@query("a20_cluster_similarity", sql("vectors", ", e AS (SELECT a.image_id AS a, b.image_id AS b, list_cosine_similarity(a.vector, b.vector) AS s FROM vectors a JOIN vectors b ON a.image_id < b.image_id WHERE round(s, 9) >= 0.42), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a), c AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a) SELECT component AS cluster_id, round(max(s), 4) AS max_similarity FROM e JOIN c ON e.a = c.id GROUP BY 1").replace("WITH vectors", "WITH RECURSIVE vectors"))
def cluster_similarity(spark, d):
    return clusters(similar_classes(vectors(spark, d), 0.42, "image_id")).select("cluster_id", "max_similarity")


@query("j17_eval_modes", sql("vectors", _LANES + ", rel AS (SELECT image_id AS id FROM vectors WHERE label = (SELECT label FROM vectors WHERE image_id = 0)), m AS (SELECT 'dense' AS mode, id, rank FROM dense UNION ALL SELECT 'sparse', id, rank FROM sparse) SELECT mode, count(*) FILTER (id IN (FROM rel) AND rank <= 10) > 0 AS hit_10, count(*) FILTER (id IN (FROM rel) AND rank <= 10) / (SELECT count(*) FROM rel) AS recall_10 FROM m GROUP BY mode"))
def eval_modes(spark, d):
    """One case by two ways of searching."""
    v = vectors(spark, d)
    rel = v.join(F.broadcast(v.where("image_id = 0").select("label")), "label").select(F.col("image_id").alias("id"), F.col("image_id").alias("pos"))
    out = None
    for mode, lane in (("dense", dense_lane(spark, d)), ("sparse", sparse_lane(spark, d))):
        m = A.case_metrics(lane.select(F.lit(mode).alias("case_id"), "id", "rank"), rel.select(F.lit(mode).alias("case_id"), "id", "pos"), (10,)).select(F.col("case_id").alias("mode"), "hit_10", "recall_10")
        out = m if out is None else out.union(m)
    return out


@query("d09_missing_thumbs", sql("images", "SELECT image_id, source_file FROM images WHERE NOT deleted AND image_id NOT IN (SELECT image_id FROM images WHERE image_id % 3 = 0)"))
def missing_thumbs(spark, d):
    thumbs = images(spark, d).where("image_id % 3 = 0").select("image_id")
    return active(spark, d).join(thumbs, "image_id", "left_anti").select("image_id", "source_file")


_REPAIR = """,
live AS (SELECT * FROM images WHERE NOT deleted),
source AS (SELECT *, length(source) <> 5 AS there FROM live),
thumbs AS (SELECT image_id FROM live WHERE image_id % 3 = 0 OR image_id IN (SELECT image_id FROM source WHERE there)),
todo AS (
  SELECT 1 AS phase, 'reconcile' AS name, (SELECT count(*) FROM (SELECT image_id FROM vectors UNION SELECT image_id FROM images WHERE image_id % 3 = 0 UNION SELECT image_id FROM images WHERE image_id % 4 = 0) WHERE image_id NOT IN (SELECT image_id FROM live)) AS n
  UNION ALL SELECT 2, 'cache', (SELECT count(*) FROM source WHERE there AND image_id % 3 <> 0)
  UNION ALL SELECT 3, 'captions', (SELECT count(*) FROM live WHERE caption_quality = 'failed')
  UNION ALL SELECT 4, 'weak_captions', (SELECT count(*) FROM live WHERE caption_quality = 'weak')
  UNION ALL SELECT 5, 'asset_types', (SELECT count(*) FROM live WHERE trim(coalesce(asset_type, '')) = '')
  UNION ALL SELECT 6, 'vectors', (SELECT count(*) FROM thumbs WHERE image_id NOT IN (SELECT image_id FROM vectors))
  UNION ALL SELECT 7, 'text_vectors', (SELECT count(*) FROM live WHERE image_id % 4 <> 0)
  UNION ALL SELECT 8, 'final_reconcile', 0)"""


def _repaired(spark, d):
    i = images(spark, d)
    records = i.select("image_id", "source", "source_file", "caption_short", "caption_detailed", "caption_quality", "asset_type", "deleted")
    tables = {
        "records": records,
        "vectors": vectors(spark, d).select("image_id", F.col("vector").cast("array<float>").alias("vector")),
        "text_vectors": i.where("image_id % 4 = 0").select("image_id", F.array(F.lit(1.0).cast("float")).alias("vector")),
        "thumbs": i.where("image_id % 3 = 0").select("image_id"),
    }
    again = lambda rows: rows.withColumn("caption_short", F.trim("caption_detailed")).withColumn("caption_quality", F.lit("ok"))
    text = F.concat_ws(" ", "caption_short", "caption_detailed", "source")
    todo = repair.phases(lambda rows: rows.where(F.length("source") != 5), again, F.lit("other"), embed_text(text), embed_text(text))
    return repair.repaired(spark, _folder(spark, "repair"), tables, todo)


@query("d10_repair_phases", sql("images vectors", _REPAIR + " SELECT * FROM todo"))
def repair_phases(spark, d):
    """What each phase of a repair mended, in order."""
    return _repaired(spark, d)[1]


@query(
    "d10_repaired_records",
    sql(
        "images vectors",
        _REPAIR
        + """ SELECT i.image_id,
  CASE WHEN NOT deleted AND caption_quality = 'weak' THEN trim(caption_detailed, ' ') ELSE caption_short END AS caption_short,
  CASE WHEN NOT deleted AND caption_quality = 'weak' THEN 'ok' ELSE caption_quality END AS caption_quality,
  CASE WHEN NOT deleted AND trim(coalesce(asset_type, '')) = '' THEN 'other' ELSE asset_type END AS asset_type,
  NOT deleted AND i.image_id IN (FROM thumbs) AS thumb,
  NOT deleted AND (i.image_id IN (SELECT image_id FROM vectors) OR i.image_id IN (FROM thumbs)) AS vector, NOT deleted AS text_vector
FROM images i""",
    ),
)
def repaired_records(spark, d):
    """The records after that, and which stores have them."""
    t = _repaired(spark, d)[0]
    out = t["records"].select("image_id", "caption_short", "caption_quality", "asset_type")
    for store, name in (("thumbs", "thumb"), ("vectors", "vector"), ("text_vectors", "text_vector")):
        out = out.join(t[store].select("image_id", F.lit(True).alias(name)), "image_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query("o05_client_sort", sql("images", "SELECT image_id, row_number() OVER (PARTITION BY lang ORDER BY source, image_id) AS rank FROM images"))
def client_sort(spark, d):
    """By a locale's order of letters, ties by id, ranked anew."""
    w = Window.partitionBy("lang").orderBy(F.collate("source", "UNICODE_CI"), "image_id")
    return images(spark, d).select("image_id", F.row_number().over(w).alias("rank"))
