"""A corpus pipeline of five operators; each stage takes and, but for the last, returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fdrspark.llm import bpe, chosen_path, langid, mixing, secrets
from fdrspark.llm.common import fold_of, release, stored, table, tables_made

#: A document stays if some language holds at least this mean probability over its bytes. On the sample tables no held-out document in a language falls below; a text that the network can't place at all does.
LEAST_SCORE = 0.35
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: those with a letter whose best score is LEAST_SCORE or more.

    Null, empty and letterless texts go. Where no language can be learned, all
    texts with a letter stay. Repeated rows stay or go alike; null ids, languages
    and sources go along; columns besides those of documents are dropped, and an
    empty table stays empty.
    """
    net = langid.train(docs.filter(fold_of("doc_id") != 1))
    if net is None:
        letter = F.udf(langid.has_letter, "boolean")
        return docs.filter(letter(F.coalesce("text", F.lit("")))).select(*COLUMNS)
    named = langid.identify(docs, net, carry=COLUMNS)
    return named.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("carried.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the least id, null last.

    Of repeated rows one stays; texts without words all stay, but for repeated
    rows; ties between equal ids go to the least digest of the text. Columns besides
    those of documents are dropped; an empty table stays empty.
    """
    return chosen_path.keep_one(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in a text gives way to a mark.

    Null texts stay null, repeated rows are treated alike, n_chars counts the code
    points of a changed text. Columns besides those of documents are dropped; an
    empty table stays empty.
    """
    found = secrets.find_secrets(docs, redacted=True, carry=COLUMNS)
    text = F.when(F.col("spans") == "", F.col("carried.text")).otherwise(F.col("redacted"))
    n_chars = F.when(F.col("spans") == "", F.col("carried.n_chars")).otherwise(F.length("redacted").cast("long"))
    return found.select(*[{"text": text, "n_chars": n_chars}.get(c, F.col(f"carried.{c}")).alias(c) for c in COLUMNS])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; sources, sizes and draws as in mixing.mix_plan.

    Documents without words have size 0 and are taken at their source's rate;
    a null source is a source. Columns besides those of documents are dropped; an
    empty table stays empty.
    """
    return mixing.mix(docs.select(*COLUMNS))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, and digests of them and of the bytes that they decode to.

    Null texts have no ids. Repeated rows, which the mix makes, repeat their
    results. Only ids and texts are read; an empty table gives no rows.
    """
    return bpe.round_trip(docs, keep_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: The first stage learns a network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each on the stored table of the one before; what a stage has made is deleted once nothing reads it."""
    docs = table(spark, sf_dir, "documents")
    first = tables_made()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, first, tables_made() - 1)  # all but this stage's own result
        first = tables_made() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
