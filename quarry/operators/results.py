"""What a search gives: records by source, cards, and lines of text.

hits: item_id, source_type, identifier, text, author, metadata, score, match_type. Metadata is JSON that a
record is read from; where it is null, broken or lacks a field, the field has its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

#: How sources are named in results.
LABELS = {"commit": "Git log", "code": "Code", "document": "Documents"}


def _read(schema: str) -> Column:
    return F.from_json("metadata", schema)


def commits(hits: DataFrame) -> DataFrame:
    short = F.coalesce(_read("short_hash string")["short_hash"], F.lit(""))
    return hits.select("item_id", "identifier", short.alias("short_hash"), "text", "author", "score", "match_type")


def code(hits: DataFrame) -> DataFrame:
    """Kinds that aren't known count as functions."""
    m = _read("file_path string, line_start long, line_end long, symbol_kind string")
    kind = F.when(m["symbol_kind"].isin(*T.KINDS), m["symbol_kind"]).otherwise("function")
    place = [F.coalesce(F.when(m[c] >= 0, m[c]), F.lit(0)).alias(c) for c in ("line_start", "line_end")]
    return hits.select("item_id", "identifier", kind.alias("symbol_kind"), F.coalesce(m["file_path"], F.lit("")).alias("file_path"), *place, "text", "score", "match_type")


def documents(hits: DataFrame) -> DataFrame:
    path = F.coalesce(_read("file_path string")["file_path"], F.lit(""))
    return hits.select("item_id", "identifier", path.alias("file_path"), "text", "score", "match_type")


RECORDS = {"commit": commits, "code": code, "document": documents}


def stable_key(identifier: str) -> Column:
    """64 bits that follow from an identifier (a commit's hash, a symbol, a file) alone."""
    return F.xxhash64(identifier)


def _lines(*parts: Column | str) -> Column:
    return F.array_join(F.array(*[F.col(p) if isinstance(p, str) else p for p in parts]), "\n", "")


def _card(rows: DataFrame, key: str, title: Column, content: Column) -> DataFrame:
    return rows.select(stable_key(key).alias("stable_key"), title.alias("title"), content.alias("content"))


def log_cards(log: DataFrame) -> DataFrame:
    """Cards of commits as git.commits gives them."""
    return _card(log, "sha", F.col("message_title"), _lines("short_hash", F.concat(F.lit("Author: "), "author_name"), F.concat(F.lit("Date: "), "time")))


def commit_cards(records: DataFrame) -> DataFrame:
    author = F.concat(F.lit("Author: "), F.coalesce("author", F.lit("")))
    return _card(records, "identifier", T.first_line(F.col("text")), _lines("short_hash", author, F.lit("Date: ")))


def code_cards(records: DataFrame) -> DataFrame:
    place = F.concat_ws(":", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    return _card(records, "identifier", T.last_segment(F.col("identifier")), _lines("file_path", place))


def document_cards(records: DataFrame) -> DataFrame:
    return _card(records, "identifier", F.col("file_path"), T.first_line(F.col("text")))


def card_fields(cards: DataFrame) -> DataFrame:
    """A commit card's content read back: hash, author and date, null where empty, so not shown; a title always."""
    lines = F.split("content", "\n", -1)

    def after(prefix: str) -> Column:
        own = F.get(F.filter(lines, lambda x: x.startswith(prefix)), 0)
        return F.nullif(F.substr(own, F.lit(len(prefix) + 1)), F.lit(""))

    other = F.filter(lines, lambda x: (x != "") & ~x.startswith("Author: ") & ~x.startswith("Date: "))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("content"))
    return cards.select("stable_key", title.alias("title"), F.get(other, 0).alias("hash"), after("Author: ").alias("author"), after("Date: ").alias("date"))


def line(source: str, records: DataFrame) -> DataFrame:
    """item_id, score, match_type and line: a record as text."""
    head, title = F.format_string("[%.3f]", "score"), T.first_line(F.col("text"))
    if source == "commit":
        body = F.concat_ws(" ", F.rpad("short_hash", F.greatest(F.length("short_hash"), F.lit(7)), F.lit(" ")), F.coalesce("author", F.lit("")))
    elif source == "code":
        kind = T.kind_label(F.col("symbol_kind"))
        place = F.concat_ws(":", "file_path", F.col("line_start").cast("string"))
        body = F.concat(F.rpad(kind, F.greatest(F.length(kind), F.lit(8)), F.lit(" ")), F.lit(" "), place, F.lit("       "), T.last_segment(F.col("identifier")))
    else:
        body = F.col("file_path")
    text = F.concat(head, F.lit(" "), body, F.lit(" — "), title, F.lit(f" [{LABELS[source]}]"))
    return records.select("item_id", "score", "match_type", text.alias("line"))
