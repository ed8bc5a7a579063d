"""Text and search tables: documents, inverted index, embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.config import BM25_B, BM25_EPSILON, BM25_K1, TEXT_TEMPLATE
from placeloom.functions.text import alias_text, build_text, clean_type, display_name, parse_level, parse_location, tokens
from placeloom.operators.blocks import if_few
from placeloom.operators.segment import dictionary, segment
from placeloom.session import written


def build_documents(merged: DataFrame, template: str = TEXT_TEMPLATE) -> DataFrame:
    """Merged places with text, level, display_name, clean_type, lat and lng; empty arrays become null."""
    kind = clean_type(F.col("type"))
    kind = F.when(kind == "", "景点").otherwise(kind)
    text = build_text(
        template, name=F.col("name"), aliases=alias_text(F.col("aliases")), city=F.col("city"), district=F.col("district"), clean_type=kind,
        tags=F.array_join("tags", "、"), behaviors=F.array_join("behaviors", "、"), description=F.col("description"),
    )
    at = parse_location(F.col("location"))
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    out = merged.withColumns({"text": text, "level": parse_level(F.col("poi_level")), "display_name": display_name(F.col("name")), "clean_type": kind, "lat": at["lat"], "lng": at["lng"]})
    return out.withColumns({c: filled(c) for c in ("tags", "behaviors", "aliases")})


def terms_of(texts: DataFrame, text: str, bigrams: bool, lexicon: DataFrame | None, *keys: str) -> DataFrame:
    """keys, term: a row per term of each text; by the words of a dictionary (word, freq) if there is one."""
    if lexicon is None:
        return texts.select(*keys, F.explode(tokens(F.col(text), bigrams)).alias("term"))
    return segment(texts, dictionary(lexicon), text, *keys).select(*keys, F.col("word").alias("term"))


@dataclass
class Bm25Index:
    """postings (term, id, tf), lengths (id, dl), terms (term, df, idf), one row of sums (n, avgdl, bigrams), and how texts were cut into terms."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    sums: DataFrame
    bigrams: bool = False
    lexicon: DataFrame | None = None

    def write(self, path: str) -> None:
        """Postings and terms are written in the order of terms, so files and row groups cover ranges of them."""
        for name in ("postings", "lengths", "terms", "sums"):
            table = getattr(self, name)
            if name in ("postings", "terms"):
                table = table.repartitionByRange("term").sortWithinPartitions("term")
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        if self.lexicon is not None:
            self.lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")

    @staticmethod
    def read(spark, path: str) -> "Bm25Index":
        """The index as written, with the choice of terms it was made with."""
        postings, lengths, terms, sums = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "sums"))
        how = sums.first()
        return Bm25Index(postings, lengths, terms, sums, how["bigrams"], spark.read.parquet(f"{path}/lexicon") if how["words"] else None)


#: Asked (query, term) pairs that are broadcast to the postings once they have been counted; some 5 MB.
ASKED_ROWS = 100_000


def _of_postings(postings: DataFrame, docs: DataFrame, bigrams: bool, epsilon: float, lexicon: DataFrame | None) -> Bm25Index:
    """All else is summed from the postings, so Spark can use their one exchange again; texts without tokens have no length."""
    lengths = postings.groupBy("id").agg(F.sum("tf").alias("dl"))
    sums = docs.agg(F.count(F.lit(1)).alias("n")).join(postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")))
    sums = sums.select("n", F.try_divide(F.col("total").cast("double"), F.col("n")).alias("avgdl"), F.lit(bigrams).alias("bigrams"), F.lit(lexicon is not None).alias("words"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    plain = df.join(F.broadcast(sums)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = F.broadcast(plain.agg(F.avg("raw").alias("mean")))
    terms = plain.join(mean).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(postings, lengths, terms, sums, bigrams, lexicon)


def bm25_index(docs: DataFrame, text: str = "text", bigrams: bool = False, epsilon: float = BM25_EPSILON, lexicon: DataFrame | None = None) -> Bm25Index:
    """The index of ``docs`` (id, text). A negative idf becomes epsilon times the mean of all idfs. With a ``lexicon`` (word, freq) texts are cut into its words."""
    postings = terms_of(docs, text, bigrams, lexicon, "id").groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return _of_postings(postings, docs, bigrams, epsilon, lexicon)


def write_bm25_index(docs: DataFrame, path: str, text: str = "text", bigrams: bool = False, epsilon: float = BM25_EPSILON, lexicon: DataFrame | None = None) -> Bm25Index:
    """Write the index of ``docs`` and read it back. Texts are cut into terms once: the other tables are made from the postings as written."""
    if lexicon is not None:
        lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")
    postings = bm25_index(docs, text, bigrams, lexicon=lexicon).postings
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    made = _of_postings(docs.sparkSession.read.parquet(f"{path}/postings"), docs, bigrams, epsilon, lexicon)
    made.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    made.sums.write.mode("overwrite").parquet(f"{path}/sums")
    made.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    return Bm25Index.read(docs.sparkSession, path)


def bm25_scores(index: Bm25Index, queries: DataFrame, k1: float = BM25_K1, b: float = BM25_B, docs: DataFrame | None = None) -> DataFrame:
    """query_id, id, score for ``queries`` (query_id, query); terms asked twice count twice, scores of 0 and less are left out.

    With ``docs`` (id, city) only documents of the query's city count. Queries are cut into terms as
    the index was. The asked terms are counted: if they are few they go to the postings, which are
    scanned where they are, so only postings of asked terms travel: once, to the lengths of their
    documents. There they meet the queries and are summed, in place. What is summed grows with the
    different queries; those of the same terms get their rows by a join.
    """
    city = [] if docs is None else ["city"]
    cut = terms_of(queries, "query", index.bigrams, index.lexicon, "query_id", *city).groupBy("query_id", *city, "term").agg(F.count(F.lit(1)).alias("qtf"))
    # Queries of the same terms have the same scores: one of them is scored, and its rows are told to all.
    bags = cut.groupBy("query_id", *city).agg(F.sort_array(F.collect_list(F.struct("term", "qtf"))).alias("bag"))
    alike = written(bags.select("query_id", *city, "bag", F.min("query_id").over(Window.partitionBy("bag", *city)).alias("first")))
    firsts = alike.filter(F.col("query_id") == F.col("first")).dropDuplicates(["first", *city])
    asked = firsts.select("first", *city, F.inline("bag"))
    few = (lambda df: F.broadcast(df)) if asked.count() <= ASKED_ROWS else (lambda df: df)
    asked = asked.join(index.terms, "term").select("first", *city, "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    lengths = index.lengths if docs is None else index.lengths.join(docs.select("id", "city"), "id")
    found = index.postings.join(few(asked.select("term").distinct()), "term", "left_semi").join(lengths, "id").join(F.broadcast(index.sums))
    part = found.select("id", *city, "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))).alias("part"))
    hits = part.join(few(asked), ["term", *city])
    # Rounded, so that texts that are copies tie in whatever order their terms are summed.
    scored = hits.groupBy("first", "id", *city).agg(F.round(F.sum(F.col("weight") * F.col("part")), 6).alias("score")).filter("score > 0")
    return scored.join(if_few(alike.select("query_id", "first", *city)), ["first", *city]).select("query_id", "id", "score")


def archive(docs: DataFrame, path: str) -> None:
    """The knowledge base as JSON lines, a folder per city."""
    docs.write.mode("overwrite").partitionBy("city").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The embeddings as a table per city, so that a city filter prunes folders."""
    vectors.write.mode("overwrite").partitionBy("city").parquet(path)


