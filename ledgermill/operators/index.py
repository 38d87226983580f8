"""An inverted index on shared files that outlives a query and takes changes.

Documents lie in blocks of about ``BLOCK``, dealt by a hash of the document's id, and a
token's postings by the same blocks, those of a block in a row.  A search takes its requests
to the blocks: the task that reads a block adds up its documents' scores and keeps the k
best of each request, see ``blocksums``, so neither postings nor sums are dealt.

Changes are segments of their own, committed with ``VersionedTables``: new postings, new
documents, which documents of older segments are gone, and what these no longer add to the
frequencies.  So a search after a change gives what an index built anew would give, without reading the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ledgermill.functions.codes import saturate
from ledgermill.functions.text import tokenize
from ledgermill.operators.blocksums import best_of_blocks, filed
from ledgermill.operators.retrieval import small, top_k
from ledgermill.sources.store import stored
from ledgermill.sources.versioned import Commit, Part, VersionedTables

#: Documents in a block, about.
BLOCK = 256
#: Bytes of text that a task files, about; less where cores would be idle.
TASK_BYTES, LEAST_TASK_BYTES = 16 << 20, 1 << 20
#: Scored documents, of the first postings and later ones, that a task gathers at least before it weighs them against its best.
FIRST_POSTINGS = 2_000
#: Requested tokens up to this number, of up to so many characters, are listed in the filters of the scans.
LISTED, LISTED_CHARS = 1_000, 128
#: Rows of requests up to this number are broadcast.
BROADCAST_TERMS = 1_000_000

KEYS = {"documents": ["id"], "postings": [], "terms": [], "totals": [], "gone": []}


def _segment(tables: VersionedTables, docs: DataFrame, number: int) -> tuple[Part, DataFrame, Part]:
    """(postings, terms, documents) of (id, text, copies) with an id once.

    Only the texts are dealt, to the tasks of their blocks; all of a block is in one task,
    so its words are counted and filed there, in order of the token, with a mark on the
    first and last row of a block.  All tokens share one number of blocks.
    """
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    size, cores = int(size or 0), docs.sparkSession.sparkContext.defaultParallelism
    blocks, tasks = n // BLOCK + 1, max(size // TASK_BYTES, min(cores, size // LEAST_TASK_BYTES)) + 1
    words = F.coalesce(tokenize("text"), F.array().cast("array<string>")).alias("words")
    documents = docs.select("id", "copies", words).select("id", F.lit(number).alias("segment"), F.size("words").cast("long").alias("dl"), F.array_distinct("words").alias("tokens"), "copies")
    dealt = docs.select("id", "text", "copies", F.lit(blocks).alias("blocks")).select(block_of("id", "blocks").alias("block"), "id", "text", "copies").repartition(tasks, "block")
    posting = StructType([StructField("id", docs.schema["id"].dataType), StructField("tf", LongType()), StructField("dl", LongType()), StructField("size", IntegerType())])
    schema = StructType([StructField("token", StringType()), StructField("block", IntegerType()), StructField("postings", ArrayType(posting)), StructField("df", LongType()), StructField("segment", IntegerType()), StructField("starts", BooleanType()), StructField("ends", BooleanType())])
    arrow = to_arrow_schema(schema)
    rows = dealt.select("block", F.lit(number).alias("segment"), "id", "copies", words).groupBy("block").applyInArrow(lambda block: filed(block, arrow), schema)
    postings = tables.write("postings", rows)
    terms = postings.rows.groupBy("token").agg(F.sum("df").alias("df")).withColumns({"blocks": F.lit(blocks), "segment": F.lit(number)})
    return postings, terms, tables.write("documents", documents)


def _sums(documents: DataFrame, sign: int) -> DataFrame:
    """(docs, words) that ``documents`` (copies, dl) add or, with -1, take away; a row."""
    total = lambda c: F.lit(sign) * F.coalesce(F.sum(c), F.lit(0))
    return documents.agg(total("copies").alias("docs"), total(F.col("copies") * F.col("dl")).alias("words"))


def block_of(id_col: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.col(blocks)).cast("int")


def _only(tokens: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Keeps the rows of a table with one of the distinct ``tokens`` (token).

    A few tokens become a filter of the scan, against which Parquet checks its row groups;
    more of them are joined.
    """
    few = [r[0] for r in tokens.select(F.when(F.length("token") <= LISTED_CHARS, F.col("token"))).limit(LISTED + 1).collect()]
    if len(few) <= LISTED and None not in few:
        return lambda rows: rows.where(F.col("token").isin(few))
    side = small(tokens, BROADCAST_TERMS)
    return lambda rows: rows.join(side, "token", "left_semi")


class SearchIndex:
    """Documents (id, text) by their tokens, under ``path`` in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, VersionedTables(spark, path, KEYS)

    @property
    def is_built(self) -> bool:
        return self.tables.latest() > 0

    def build(self, docs: DataFrame) -> SearchIndex:
        """Null ids are left out, null texts have no tokens; of repeated ids one row counts.  With a column ``copies`` a document counts as so many."""
        rows = docs.where("id is not null").withColumn("copies", F.col("copies") if "copies" in docs.columns else F.lit(1).cast("long"))
        if rows.count() > rows.select("id").distinct().count():
            rows = stored(rows.dropDuplicates(["id"]), "rows")
        postings, terms, documents = _segment(self.tables, rows, 0)
        totals = _sums(documents.rows, 1)
        self.tables.commit(Commit("build").replace("postings", postings).replace("terms", terms.sortWithinPartitions("token")).replace("documents", documents).replace("totals", totals).replace("gone", documents.rows.where("false").select("id", "segment")))
        return self

    def change(self, upserts: DataFrame, deletes: DataFrame | None = None) -> int:
        """Documents (id, text) put in or replaced, and documents (id) taken out, in one commit; the corpus is not read."""
        at = self.tables.latest()
        new = stored(upserts.where("id is not null").dropDuplicates(["id"]).withColumn("copies", F.lit(1).cast("long")), "upserts")
        postings, terms, documents = _segment(self.tables, new, at)
        touched = new.select("id") if deletes is None else new.select("id").union(deletes.select("id")).distinct()
        old = stored(self.tables.read("documents", at).join(small(touched), "id", "left_semi"), "replaced")
        lost = old.select("copies", F.explode("tokens").alias("token")).groupBy("token").agg((-F.sum("copies")).alias("df"))
        less = lost.select("token", "df", F.lit(None).cast(terms.schema["blocks"].dataType).alias("blocks"), F.lit(at).alias("segment"))
        commit = Commit("change").append("postings", postings).append("terms", terms.select(*less.columns).union(less)).append("totals", _sums(documents.rows, 1).union(_sums(old, -1))).append("gone", old.select("id", "segment"))
        if deletes is not None:
            commit.delete("documents", deletes.join(new.select("id"), "id", "left_anti"))
        return self.tables.commit(commit.upsert("documents", documents), at)

    def size(self) -> tuple[int, int]:
        """(documents, words)."""
        r = self.tables.read("totals").agg(F.sum("docs"), F.sum("words")).first()
        return int(r[0] or 0), int(r[1] or 0)

    def document_frequency(self) -> DataFrame:
        """(token, df) of tokens that a document has."""
        return self.tables.read("terms").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    # --- searches -----------------------------------------------------------------------

    def bm25(self, requests: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
        """(qid, id, raw, score, rank) of Okapi BM25 for (qid, token, tf); see ``retrieval.bm25``."""
        weighed, gain, _ = self._bm25_terms(requests, k1, b, epsilon)
        found = self._search(weighed, gain, k, "raw")
        return found.withColumn("score", F.round(saturate(F.col("raw")), 6)).select("qid", "id", "raw", "score", "rank")

    def _bm25_terms(self, requests: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25):
        docs, words = self.size()
        mean = words / docs if docs else 0.0
        idf = F.log(F.lit(float(docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        floor = self.document_frequency().agg(F.coalesce(F.lit(epsilon) * F.avg(idf), F.lit(0.0)).alias("floor"))
        only = _only(requests.select("token").distinct())
        wanted = self._wanted(requests, only).crossJoin(F.broadcast(floor))  # one row
        weighed = wanted.withColumn("w", F.col("qtf") * F.when(idf < 0, F.col("floor")).otherwise(idf))
        return weighed, lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)), only

    def coverage(self, requests: DataFrame, k: int = 3) -> DataFrame:
        """(qid, id, score, rank): the share of a request's IDF mass that a document holds, for (qid, token); see ``retrieval.coverage``."""
        weighed, gain, _ = self._coverage_terms(requests)
        return self._search(weighed, gain, k, "score").select("qid", "id", "score", "rank")

    def overlap(self, requests: DataFrame, k: int = 20) -> DataFrame:
        """(qid, id, score, rank): of the different tokens of a request and a document the share that both have, for (qid, token)."""
        asked = requests.select("qid", "token").distinct()
        counted = asked.withColumns({"w": F.lit(1.0), "asked": F.count(F.lit(1)).over(Window.partitionBy("qid")).cast("double")})
        share = lambda part, asked, size: part / (asked + size - part)
        return self._search(counted, lambda tf, dl: 1.0, k, "score", share).select("qid", "id", "score", "rank")

    def _coverage_terms(self, requests: DataFrame):
        n = float(max(self.size()[0], 1))
        asked = requests.select("qid", "token").distinct()
        only = _only(asked.select("token").distinct())
        held = self._wanted(asked.withColumn("tf", F.lit(1)), only, "left")
        idf = F.when(F.col("df").isNull(), F.log(F.lit(1 + n))).otherwise(F.log(1 + n / (1 + F.col("df"))))
        weighed = held.withColumn("idf", idf).withColumn("w", F.col("idf") / F.sum("idf").over(Window.partitionBy("qid")))
        return weighed.where("df is not null"), lambda tf, dl: 1.0, only

    def scores(self, requests: DataFrame, pairs: DataFrame) -> DataFrame:
        """(qid, id, keyword, coverage) of given ``pairs`` (qid, id), 0 without a common token, for requests (qid, token, tf)."""
        keyword, coverage = self._bm25_terms(requests), self._coverage_terms(requests)
        one = self._of_pairs(*keyword, pairs).withColumnRenamed("part", "raw")
        two = self._of_pairs(*coverage, pairs).withColumnRenamed("part", "held")
        both = pairs.select("qid", "id").join(one, ["qid", "id"], "left").join(two, ["qid", "id"], "left")
        raw = F.coalesce(F.round("raw", 6), F.lit(0.0))
        return both.select("qid", "id", F.when(raw > 0, F.round(saturate(raw), 6)).otherwise(0.0).alias("keyword"), F.coalesce(F.round("held", 6), F.lit(0.0)).alias("coverage"))

    def weights(self, requests: DataFrame) -> tuple[DataFrame, Callable]:
        """((qid, token, keyword, coverage), gain) of requests (qid, token, tf): what a token counts for, tokens of no document left out.

        A document's raw BM25 is the sum of keyword * gain(tf, words), its coverage that of coverage.
        """
        keyword, gain, _ = self._bm25_terms(requests)
        coverage, _, _ = self._coverage_terms(requests)
        return keyword.select("qid", "token", F.col("w").alias("keyword")).join(coverage.select("qid", "token", F.col("w").alias("coverage")), ["qid", "token"]), gain

    def _of_pairs(self, weighed: DataFrame, gain, only, pairs: DataFrame) -> DataFrame:
        live = pairs.select("qid", "id").join(self.tables.read("documents").select("id", "segment"), "id")
        hit = self._looked_up(live, small(stored(weighed.select("qid", "token", "w"), "weighed"), BROADCAST_TERMS), only, gain)
        return hit.groupBy("qid", "id").agg(F.sum("part").alias("part"))

    def _looked_up(self, near: DataFrame, terms: DataFrame, only, gain) -> DataFrame:
        """(qid, id, part) of the tokens ``terms`` (qid, token, w) in the documents ``near`` (qid, id, segment), from their blocks alone."""
        mine = near.join(F.broadcast(self._blocks()), "segment").select("segment", block_of("id", "blocks").alias("block"), "id", "qid")
        # the sought documents go to their block, so that no posting leaves it
        sought = mine.groupBy("segment", "block", "id").agg(F.collect_set("qid").alias("qids")).groupBy("segment", "block").agg(F.map_from_entries(F.collect_list(F.struct("id", "qids"))).alias("near"))
        blocks = only(self.tables.read("postings")).join(small(terms.select("token").distinct(), BROADCAST_TERMS), "token", "left_semi").join(sought, ["segment", "block"])
        asked = F.transform("postings", lambda p: F.struct(p["id"].alias("id"), p["tf"].alias("tf"), p["dl"].alias("dl"), F.col("near")[p["id"]].alias("qids")))
        met = blocks.select("token", F.explode(F.filter(asked, lambda p: p["qids"].isNotNull())).alias("p")).select("token", "p.id", "p.tf", "p.dl", F.explode("p.qids").alias("qid"))
        return met.join(terms, ["token", "qid"]).select("qid", "id", (F.col("w") * gain(F.col("tf"), F.col("dl"))).alias("part"))

    def _blocks(self) -> DataFrame:
        """(segment, blocks), a row a segment."""
        return self.tables.read("terms").where("blocks is not null").groupBy("segment").agg(F.max("blocks").alias("blocks"))

    def _wanted(self, requests: DataFrame, only, how: str = "inner") -> DataFrame:
        """(qid, token, qtf, df) of requests (qid, token, tf): documents of each token."""
        held = only(self.tables.read("terms")).groupBy("token").agg(F.sum("df").alias("df"))
        return requests.select("qid", "token", F.col("tf").alias("qtf")).join(held.where("df > 0"), "token", how)

    def _search(self, weighed: DataFrame, gain, k: int, name: str, value: Callable = lambda part, asked, size: part) -> DataFrame:
        """(qid, id, ``name``, rank): the k best of (qid, token, w), above 0 and rounded.

        ``part`` is a document's sum of w * gain(tf, dl), ``asked`` a column of the request,
        ``size`` the document's number of different tokens.
        """
        asked = F.col("asked") if "asked" in weighed.columns else F.lit(0.0)
        terms = stored(weighed.select("qid", "token", "w", asked.alias("asked")), "terms")
        gone = self.tables.read("gone")  # replaced documents stay in old postings
        narrow = terms.count() <= BROADCAST_TERMS and gone.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        few = F.broadcast if narrow else lambda rows: rows
        requests = terms.groupBy("token").agg(F.collect_list(F.struct("qid", "w", "asked")).alias("requests"))
        missing = gone.join(F.broadcast(self._blocks()), "segment").select("segment", block_of("id", "blocks").alias("block"), "id").groupBy("segment", "block").agg(F.collect_list("id").alias("gone"))
        rows = self.tables.read("postings").select("segment", "block", F.col("_metadata.file_block_start").alias("split"), "starts", "ends", "token", "postings")
        rows = rows.join(few(requests), "token", "left").where("requests is not null or starts or ends").join(few(missing), ["segment", "block"], "left")
        if not narrow:  # the joins have dealt the postings
            rows = rows.withColumn("split", F.lit(0)).repartition("segment", "block").sortWithinPartitions("segment", "block", "token")
        rows = rows.select("segment", "block", "split", "starts", "ends", "postings", "requests", "gone")
        ids = rows.schema["postings"].dataType.elementType["id"].dataType
        schema = StructType([StructField("qid", terms.schema["qid"].dataType), StructField("id", ids), StructField("part", DoubleType()), StructField("asked", DoubleType()), StructField("size", IntegerType())])
        arrow, patience = to_arrow_schema(schema), FIRST_POSTINGS
        found = rows.mapInArrow(lambda batches: best_of_blocks(batches, arrow, k, gain, value, patience), schema)
        # a document comes once, or in parts where its block lies in two splits of a file
        whole = found.groupBy("qid", "id").agg(F.sum("part").alias("part"), F.max("asked").alias("asked"), F.max("size").alias("size"))
        scored = whole.select("qid", "id", F.round(value(F.col("part"), F.col("asked"), F.col("size")), 6).alias(name))
        return stored(top_k(scored.where(F.col(name) > 0), k, name), "found")  # read by more than one step
