"""Benchmark decontamination by a positional inverted index, in DataFrame
functions only.

1. Term statistics: how often each benchmark term occurs in the corpus.
2. The postings (document, place) of every phrase's two rarest terms are
   stored, shifted by the term's offset in the phrase.
3. The shifted lists are intersected: a start that both name is a candidate.
4. Candidates are compared word by word in the few texts that have one;
   occurrences, covered words and items follow.

Proximity matches go the same way: the shifted lists are widened by the slop
before they are intersected, and all words of the phrase are compared.

Benchmark phrases are looked up from a broadcast table of at most
``PHRASES_AT_ONCE`` rows; a larger benchmark is taken in several blocks, each
against all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shipcast.llm.common import staged, text_key

PHRASES_AT_ONCE = 100_000
#: What lies between words: ASCII other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands after a document's last word; no word holds this character.
MARK = "\x01"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_letters(word: Column) -> Column:
    """Lower case of A-Z alone (other letters stay as they are)."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, CAPITALS, SMALL)
    )


def raw_words(text: Column) -> Column:
    """Words in order; the first and last element may be an empty string."""
    return F.split(F.coalesce(text, F.lit("")), GAP, -1)


def word_count(words: Column) -> Column:
    ends = F.when(words[0] == "", 1).otherwise(0) + F.when(
        (F.size(words) > 1) & (F.element_at(words, -1) == ""), 1
    ).otherwise(0)
    return (F.size(words) - ends).cast("long")


def phrases(items: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (``phrase``, ``words``) and the items of each.

    Every run of ``length`` words of an item; an item of fewer, but not none,
    is one phrase.  A null item_id is named 'null'.
    """
    words = F.filter(F.transform(raw_words(F.col("text")), small_letters), lambda w: w != "")
    runs = (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words.alias("all"))
        .where(F.size("all") > 0)
        .select("item", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (length - 1)))).alias("at"))
        .select("item", F.slice("all", F.col("at"), F.lit(length)).alias("words"))
        .withColumn("phrase", F.array_join("words", " "))
    )
    members = runs.select("phrase", "item").distinct()
    return runs.select("phrase", "words").dropDuplicates(["phrase"]), members


def small_side(df: DataFrame, bound: int) -> DataFrame:
    """Broadcast when the counted rows are within the bound, else leave the
    choice to Spark."""
    return F.broadcast(df) if df.count() <= bound else df


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Corpus frequency of every term of ``terms``, summed before the shuffle."""
    words = docs.select(F.explode(raw_words(F.col("text"))).alias("w")).select(small_letters(F.col("w")).alias("term"))
    return words.join(small_side(terms, 10 * PHRASES_AT_ONCE), "term").groupBy("term").agg(F.count("*").alias("n"))


def rarest_first(table: DataFrame, counts: DataFrame) -> DataFrame:
    """Per phrase its rarest and second rarest term with their offsets.

    A phrase with a term that the corpus lacks cannot occur and is left out.
    """
    placed = table.select("phrase", F.posexplode("words").alias("offset", "term"))
    ranked = placed.join(counts, "term", "left").groupBy("phrase").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("t")
    )
    return (
        ranked.where(F.col("t")[0]["n"] > 0)
        .select(
            "phrase",
            F.col("t")[0]["term"].alias("term"),
            F.col("t")[0]["offset"].alias("offset"),
            F.coalesce(F.get("t", F.lit(1))["term"], F.col("t")[0]["term"]).alias("second"),
            F.coalesce(F.get("t", F.lit(1))["offset"], F.col("t")[0]["offset"]).alias("second_offset"),
        )
        .join(table, "phrase")
    )


POSTING = "pid long, term string, offset int, part int"


def find_phrases(
    spark: SparkSession, docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrase occurrences by intersecting posting lists.

    Returns ``(documents, occurrences, members)``: one ``doc_id, text_key,
    n_words`` row per input row; distinct ``doc_id, text_key, start, size,
    phrase, exact`` rows; and the items of each phrase.  With ``slop`` > 0,
    occurrences also holds proximity matches (``exact = false``): starts, none
    below 0, at which every word of the phrase stands at most ``slop`` words
    from its place, unless the phrase itself starts at most ``slop`` words
    from there.  Equal words of a phrase may be met by one word of the text.
    """
    table, members = phrases(items.select("item_id", "text"), length)
    table = staged(spark, table, "phrases")
    members = staged(spark, members, "phrase-items")
    n = table.count()
    terms = table.select(F.explode("words").alias("term")).distinct()
    table = staged(
        spark, rarest_first(table, term_counts(docs, terms)).withColumn("pid", F.monotonically_increasing_id()), "rarest"
    )
    blocks = max(1, -(-n // PHRASES_AT_ONCE))
    found = [
        staged(spark, _postings(docs, table.where(F.pmod("pid", F.lit(blocks)) == block), block == 0), "postings")
        for block in range(blocks)
    ]
    postings = found[0]
    for more in found[1:]:
        postings = postings.unionByName(more)
    documents = postings.where("part = 0").select("doc_id", "text_key", "n_words")
    key = ["doc_id", "text_key", "start", "pid"]
    lists = postings.where("part > 0")
    # both shifted lists name the start: an intersection
    both = staged(
        spark, lists.groupBy(*key).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(*key), "starts"
    )
    occurrences = _compared(spark, docs, both, table).withColumn("exact", F.lit(True))
    if slop:
        # every start that leaves a term within the slop; both lists must name it
        wide = lists.withColumn("start", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop))).where("start >= 0")
        wide = wide.groupBy(*key).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(*key)
        near = _compared(spark, docs, staged(spark, wide, "near-starts"), table, slop).alias("n")
        whole = occurrences.alias("o")
        same = F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("n.text_key") == F.col("o.text_key")) & (F.col("n.phrase") == F.col("o.phrase"))
        near = near.join(whole, same & (F.abs(F.col("n.start") - F.col("o.start")) <= slop), "left_anti")
        occurrences = occurrences.unionByName(near.withColumn("exact", F.lit(False)))
    return documents, occurrences, members


def _postings(docs: DataFrame, table: DataFrame, with_documents: bool) -> DataFrame:
    """Postings of each phrase's two rarest terms, shifted to the phrase's
    start; with ``with_documents`` also one row (part 0) per document, by a
    mark after its last word."""
    lookup = table.select(
        "pid",
        F.inline(
            F.array(
                F.struct("term", "offset", F.lit(1).alias("part")),
                F.struct(F.col("second").alias("term"), F.col("second_offset").alias("offset"), F.lit(2).alias("part")),
            )
        ),
    )
    if with_documents:
        mark = docs.sparkSession.createDataFrame([(None, MARK, 0, 0)], POSTING)
        lookup = mark.unionByName(lookup)
    # whatever stands beside a generator is computed for each of its rows, so
    # the columns of the document come first; only small ones are carried along
    split = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), raw_words(F.col("text")).alias("ws"))
    listed = split.select(
        "doc_id",
        "text_key",
        word_count(F.col("ws")).alias("n_words"),
        F.when(F.col("ws")[0] == "", 1).otherwise(0).alias("lead"),
        F.concat("ws", F.array(F.lit(MARK))).alias("ws"),
    ).select("doc_id", "text_key", "n_words", "lead", F.posexplode("ws").alias("pos", "w"))
    hits = listed.withColumn("term", small_letters(F.col("w"))).join(F.broadcast(lookup), "term")
    return hits.select(
        "doc_id",
        "text_key",
        F.when(F.col("part") == 0, F.col("n_words")).alias("n_words"),
        (F.col("pos") - F.col("lead") - F.col("offset")).alias("start"),
        "pid",
        "part",
    )


def _stands(words: Column, found: Column, slop: int) -> Column:
    """Whether a phrase stands in ``words`` at a start: word by word in place,
    or each of its words at most ``slop`` from its place."""
    if not slop:
        return (found["start"] >= 0) & (F.slice(words, F.greatest(found["start"], F.lit(0)) + 1, F.size(found["words"])) == found["words"])

    def within(j: Column) -> Column:
        low = F.greatest(found["start"] + j - slop, F.lit(0))
        return F.array_contains(F.slice(words, low + 1, found["start"] + j + slop + 1 - low), F.get(found["words"], j))

    return F.forall(F.sequence(F.lit(0), F.size(found["words"]) - 1), within)


def _compared(spark: SparkSession, docs: DataFrame, starts: DataFrame, table: DataFrame, slop: int = 0) -> DataFrame:
    """Starts at which the whole phrase stands, compared in the texts that
    have a start left."""
    wanted = (
        starts.join(small_side(table.select("pid", "phrase", "words"), PHRASES_AT_ONCE), "pid")
        .groupBy(F.col("doc_id").alias("w_doc"), F.col("text_key").alias("w_key"))
        .agg(F.collect_list(F.struct("start", "phrase", "words")).alias("wanted"))
    )
    wanted = staged(spark, wanted, "wanted")
    keys = small_side(wanted.select("w_doc", "w_key"), 1_000_000)
    keyed = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    match = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_key") == F.col("w_key"))
    rows = keyed.join(keys, match, "left_semi").join(wanted, match)
    words = F.filter(F.transform(raw_words(F.col("text")), small_letters), lambda w: w != "")
    # the one-row explode keeps the words a computed column: they are split once
    rows = rows.select("doc_id", "text_key", "wanted", F.explode(F.array(words)).alias("ws"))
    right = F.filter("wanted", lambda c: _stands(F.col("ws"), c, slop))
    found = rows.select("doc_id", "text_key", F.explode(right).alias("c"))
    return staged(
        spark,
        found.select(
            "doc_id", "text_key", F.col("c.start").alias("start"), F.size("c.words").alias("size"), F.col("c.phrase").alias("phrase")
        ).distinct(),
        "occurrences",
    )


def _items(occurrences: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """The items, sorted, that each document's occurrences belong to."""
    key = ["doc_id", "text_key"]
    return (
        occurrences.select(*key, "phrase").distinct()
        .join(members, "phrase")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set("item")).alias(name))
    )


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 0) -> DataFrame:
    """One row per row of ``doc_id, text``: ``doc_id, text_key, n_words, n_hit,
    n_items, item_ids, contaminated``; with ``slop`` > 0 also ``near_ids``, the
    items that have a proximity match (see ``find_phrases``) in the text.

    A null text has no words; a null doc_id is kept; repeated rows each get
    a row; other columns are ignored.  An empty benchmark hits nothing.
    """
    documents, all_occurrences, members = find_phrases(spark, docs.select("doc_id", "text"), items, length, slop)
    occurrences = all_occurrences.where("exact").drop("exact")
    key = ["doc_id", "text_key"]
    order = W.partitionBy(*key).orderBy("start", "stop")
    runs = occurrences.select(*key, "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
    # words of a run that no earlier run of the document covers
    reach = F.coalesce(F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = (
        runs.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reach)))
        .groupBy(*key)
        .agg(F.sum("new").alias("n_hit"))
    )
    named = _items(occurrences, members, "item_ids")
    hit = covered.join(named, key)
    marked = documents.alias("d").join(
        hit.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")), "left"
    )
    none = F.array().cast("array<string>")
    ids = F.coalesce("item_ids", none)
    out = marked.select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.text_key").alias("text_key"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
    if not slop:
        return out
    near = _items(all_occurrences.where(~F.col("exact")), members, "near_ids").alias("n")
    same = F.col("o.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("o.text_key") == F.col("n.text_key"))
    return out.alias("o").join(near, same, "left").select("o.*", F.coalesce("n.near_ids", none).alias("near_ids"))
