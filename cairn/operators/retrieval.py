"""Lexical retrieval for a stated set of questions against all records.

Questions are parameters: they come as a Python list, go into the plan as a literal array (in blocks
of ``BLOCK`` questions) and each record is scored against them where it stands. No join, no
shuffle of the corpus; what follows moves (question, record) rows with a score only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bag_score, joined_haystack, json_haystack, mixed_tokens, token_set
from ..session import cut, spread
from .ranking import EVIDENCE_ORDER, missing, pyramid_keys, ranked, raw_of, type_order

BLOCK = 200
# The fields of an evidence record, in their order.
NODE_FIELDS = [
    "id", "title", "evidence_type", "year", "month", "source", "population", "intervention", "comparator", "main_findings",
    "quality", "recommendation_direction", "dose_signal", "safety_signals", "tags", "citation",
]
# Topics that always count as relevant to a case.
FLOOR_TOPICS = ["diagnosis", "severity", "treatment", "follow_up"]
# Fixed value: the text of a question without entries.
NOTHING_FOUND = "No relevant evidence found in the local pediatric MPP knowledge base."


@dataclass(frozen=True)
class Question:
    """``types``: None for all evidence types, an empty tuple for none."""

    qid: int
    text: str
    types: tuple[str, ...] | None = None


def faults(questions: Sequence[Question]) -> list[tuple[int, str, str]]:
    """Blank texts and types outside the vocabulary: (qid, check, detail)."""
    found = [(q.qid, "empty_question", "") for q in questions if not (q.text or "").strip()]
    return found + [(q.qid, "invalid_evidence_type", ",".join(bad)) for q in questions if (bad := sorted(set(q.types or ()) - set(EVIDENCE_ORDER)))]


def question_table(spark: SparkSession, questions: Sequence[Question]) -> DataFrame:
    return spark.createDataFrame([(q.qid, q.text) for q in questions], "qid bigint, text string")


def question_array(questions: Sequence[Question]) -> Column:
    return F.array(*(
        F.struct(
            F.lit(q.qid).cast("bigint").alias("qid"),
            F.lit(q.text).alias("text"),
            (F.lit(None) if q.types is None else F.array(*map(F.lit, q.types))).cast("array<string>").alias("types"),
        )
        for q in questions
    ))


def title_questions(records: DataFrame, every: int = 50) -> DataFrame:
    """Questions from records: the titles of the rows whose key ``every`` divides, a missing title as an empty text; ``qid`` is the key."""
    return records.where(F.col("_ord") % every == 0).select(F.col("_ord").alias("qid"), F.coalesce("title", F.lit("")).alias("text"), F.lit(None).cast("array<string>").alias("types"))


def result_questions(results: DataFrame, key: str, inputs: Sequence[str]) -> DataFrame:
    """Questions from what earlier steps found: a JSON array of their results (columns ``inputs``, structs or arrays), names included; ``qid`` is the key.

    Fields that are null are left out; a step without a result is a JSON null.
    """
    text = F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(F.to_json(c), F.lit("null")) for c in inputs)), F.lit("]"))
    return results.select(F.col(key).cast("bigint").alias("qid"), text.alias("text"), F.lit(None).cast("array<string>").alias("types"))


def _asked(df: DataFrame, questions: Sequence[Question] | DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """Each row of ``df`` with each question as ``_q``. A table of questions has its tokens taken once and is joined in partitions, not sent whole."""
    if isinstance(questions, DataFrame):
        return df.crossJoin(cut(spread(questions.select(F.struct("qid", "text", "types", tokens(F.col("text")).alias("tokens")).alias("_q")))))
    return _listed(df, questions).withColumn("_q", F.col("_q").withField("tokens", tokens(F.col("_q.text"))))


def _listed(df: DataFrame, questions: Sequence[Question]) -> DataFrame:
    blocks = [questions[i : i + BLOCK] for i in range(0, len(questions), BLOCK)]
    return reduce(DataFrame.unionByName, [df.withColumn("_q", F.explode(question_array(b))) for b in blocks])


def retrieve(nodes: DataFrame, questions: Sequence[Question] | DataFrame, fields: Sequence[str] = NODE_FIELDS, fallback: bool = True) -> DataFrame:
    """``qid``, ``types``, ``score`` and the node's ranking columns, for each question and node that it retrieves.

    A node's score is the number of the question's tokens, repeats counted, that occur in its JSON, keys
    included. Nodes that score are retrieved; where none does (or there are no tokens) all are, with score 0, unless ``fallback`` is off. The
    rows that score are cut to the shared folder.
    """
    kept = ["_ord", "id", "evidence_type", "quality", "year", "month"]
    raw = raw_of(nodes)
    # where the records are there as they came, a JSON null of the quality is told from a missing one
    quality = F.col("quality") if raw is None else F.when(F.col("quality").isNull() & ~missing("quality", raw), "unknown").otherwise(F.col("quality")).alias("quality")
    narrow = [quality if c == "quality" else F.col(c) for c in kept]
    hay = json_haystack(fields, None if raw is None else F.col(raw)).alias("_hay")
    asked = _asked(spread(nodes.select(*dict.fromkeys([*kept, *fields, *([raw] if raw else [])]))).select(*narrow, hay), questions, mixed_tokens)
    hits = asked.select("_q.qid", "_q.types", *kept, bag_score(F.col("_q.tokens"), F.col("_hay")).cast("bigint").alias("score")).where("score > 0")
    hits = cut(hits)  # each record is read, written as JSON and scored once
    if not fallback:
        return hits
    # Questions that nothing matches take all records.
    all_ = nodes.sparkSession.createDataFrame([(q.qid, None if q.types is None else list(q.types)) for q in questions], "qid bigint, types array<string>") if not isinstance(questions, DataFrame) else questions.select("qid", "types")
    unmatched = cut(all_.join(hits.select("qid").distinct(), "qid", "left_anti"))
    return hits.unionByName(nodes.select(*narrow).crossJoin(unmatched).select("qid", "types", *kept, F.lit(0).cast("bigint").alias("score")))


def of_types(retrieved: DataFrame) -> DataFrame:
    """What is left for the types that a question asks for; comes after retrieval, so it may be nothing."""
    return retrieved.where(F.col("types").isNull() | F.array_contains("types", F.col("evidence_type")))


def record_keys() -> list[Column]:
    """The order of records with the same score: type, newest year, id and row key."""
    return [type_order(F.col("evidence_type")).alias("_type"), (-F.coalesce("year", F.lit(0))).alias("_year"), F.coalesce("id", F.lit("")).alias("_id"), F.col("_ord").alias("_row")]


def retrieval_order(retrieved: DataFrame) -> DataFrame:
    """Place by score, then type, newest year, id and row key, within each question."""
    return ranked(retrieved, [(-F.col("score")).alias("_score"), *record_keys()], within=["qid"], name="place")


def pyramid_order(retrieved: DataFrame) -> DataFrame:
    """Place in the evidence pyramid within each question."""
    return ranked(retrieved, pyramid_keys(), within=["qid"], name="place")


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each question; ties in the order of the rows. The limit applies in each task before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("_ord").asc())
    return scored.where("score > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))


def knowledge_top(kb: DataFrame, questions: Sequence[Question] | DataFrame, k: int = 5) -> DataFrame:
    """Entries that share most distinct words with each question: a top-k report without a fallback."""
    tags = F.array_join(F.col("tags"), " ")
    words = token_set(joined_haystack(F.col("id"), F.col("topic"), tags, F.col("statement"), F.col("clinical_use")))
    asked = _asked(kb.select("_ord", "id", "topic", "statement", "clinical_use", words.alias("_words")), questions, token_set)
    return _top(asked.select("_q.qid", "_ord", "id", "topic", "statement", "clinical_use", F.size(F.array_intersect("_q.tokens", "_words")).cast("bigint").alias("score")), k)


def knowledge_for_case(kb: DataFrame, questions: Sequence[Question] | DataFrame, k: int = 5) -> DataFrame:
    """As above without the id among the words; entries of the standing topics score 1 even if they share nothing."""
    tags = F.array_join(F.col("tags"), " ")
    words = token_set(joined_haystack(F.col("topic"), tags, F.col("statement"), F.col("clinical_use")))
    asked = _asked(kb.select("_ord", "id", "topic", words.alias("_words")), questions, token_set)
    shared = F.size(F.array_intersect("_q.tokens", "_words"))
    score = F.when((shared == 0) & F.col("topic").isin(*FLOOR_TOPICS), 1).otherwise(shared)
    return _top(asked.select("_q.qid", "_ord", "id", "topic", score.cast("bigint").alias("score")), k)


def knowledge_text(top: DataFrame, questions: Sequence[Question]) -> DataFrame:
    """One text per question, a line per entry; a fixed sentence where there is none. A question has at most k entries."""
    line = F.format_string("[%s] %s: %s Use: %s", *(F.coalesce(c, F.lit("None")) for c in ("id", "topic", "statement", "clinical_use")))
    texts = top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    asked = top.sparkSession.createDataFrame([(q.qid,) for q in questions], "qid bigint")
    return asked.join(texts, "qid", "left").select("qid", F.coalesce("text", F.lit(NOTHING_FOUND)).alias("text"))

