"""Line dedup with a log-template tree, in DataFrame functions only.

A line parses down a tree of fixed depth: its number of words, its first `LEAD` words, then the rest. Variable fields
become wildcards on the way: a word with a digit or an at sign, and a word that starts with A-Z after the first. The
last level generalises further: besides the whole template, a line of `HALVES_FROM` words or more belongs to the template that
leaves its last part open and to the one that leaves its middle part open. Lines under `LEAD` words and lines with more wildcards than
words generalise no further than the line as it is. A template is a 64-bit hash of its level, word count and words. One that recurs
in `min_docs` documents is dropped from all of them but the first (by doc_id).

Templates are counted by one pre-aggregated shuffle of hashes, so a line in a third of all documents is one row per
task. Templates in more than a `HOT_SHARE`-th of all rows, `HOT_SHARE` at most, meet their documents by broadcast, the others by a
shuffle, in which none of them is a hot key; texts are moved once, to meet the templates to drop.

Defined cases: null text is empty and stays so (null in, empty out); blank lines stay; a null id sorts first; rows that share an id count
each (the SQL below is for unique ids) and share what is dropped; an empty table gives no rows; columns of the input with clashing names, in any case, are kept apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverline.llm.common import NULL_ID, documents, durable, fresh

LEAD = 3
HALVES_FROM = 8
MIN_DOCS = 10
HOT_SHARE = 1000
WILD = "<*>"


#: White space in a line other than one single space; then, after a border, a word with a digit or an at sign or one that starts with A-Z after another word.
SPACES = "[\\x20\\x09\\x0B-\\x0D]{2,}+|[\\x09\\x0B-\\x0D]"
ODD_SPACES = ("\t", "\x0b", "\x0c", "\r", "  ")
FIELDS = "(^|[\\x20\\n])(?:[^\\x20\\n0-9@]*+[0-9@]|(?<=[^\\x20\\n]\\x20)[A-Z])[^\\x20\\n]*+"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def masked(text: Column) -> Column:
    """The lines of a text with single spaces between words and wildcards in place; the whole text is scanned at once, not word by word."""
    odd = reduce(lambda found, part: found | F.contains(text, F.lit(part)), ODD_SPACES[1:], F.contains(text, F.lit(ODD_SPACES[0])))
    single = F.when(odd, F.regexp_replace(text, SPACES, " ")).otherwise(text)
    return F.transform(lines_of(F.regexp_replace(single, FIELDS, f"$1{WILD}")), lambda line: F.trim(line))


def templates(line: Column, mask: Column) -> Column:
    """Hashes of the templates that a line, also given masked, belongs to; none for a blank line."""

    def keys(w: Column) -> Column:
        n = F.size(w)
        cut = F.lit(LEAD) + F.floor((n - LEAD) / 2).cast("int")
        level = lambda k, part: F.xxhash64(F.lit(k), n, part)
        whole = F.array(level("all", mask))
        back = F.concat(F.substring_index(mask, " ", LEAD), F.lit(" "), F.call_function("substring_index", mask, F.lit(" "), cut - n))
        halves = F.array(level("front", F.call_function("substring_index", mask, F.lit(" "), cut)), level("back", back))
        usable = (n >= LEAD) & (2 * (n - F.size(F.array_remove(w, WILD))) <= n)
        exact = F.array(F.xxhash64(F.lit("line"), line))
        return F.when(usable & (n >= HALVES_FROM), F.concat(whole, halves)).when(usable, whole).otherwise(exact)

    bound = F.transform(F.array(F.split(mask, " ")), keys)[0]  # the words are bound once, not copied into every use
    return F.when(mask == "", F.array().cast("array<bigint>")).otherwise(bound)


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the text cleaned, and two more: lines before and lines dropped (`counters` names them)."""
    before, dropped = counters(docs)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = docs.select(ident.alias("__id"), F.explode(F.array_distinct(F.flatten(F.zip_with(lines_of(text), masked(text), templates)))).alias("__key"))
    seen = durable(seen, "templates")  # parsed once, read twice
    counted = durable(seen.groupBy("__key").agg(F.count("*").alias("__n"), F.min("__id").alias("__first")).where(F.col("__n") >= min_docs), "recurring")
    hot = counted.where(F.col("__n") > F.lit(seen.count() // HOT_SHARE)).select("__key", "__first")  # fewer than HOT_SHARE + 1 rows
    often = F.broadcast(hot)
    rare = seen.join(often, "__key", "left_anti").hint("merge").join(counted.select("__key", "__first"), "__key")
    gone = seen.join(often, "__key").unionByName(rare).where("__id > __first")
    per_doc = gone.groupBy("__id").agg(F.collect_set("__key").alias("__keys"))  # at most the templates of one document
    others = F.struct(F.lit(0), *(F.col(f"`{c}`") for c in docs.columns if c != text_col))  # no name of docs can clash
    rows = docs.select(ident.alias("__id"), text.alias("__body"), others.alias("__row"))
    joined = rows.hint("merge").join(per_doc, "__id", "left").withColumn("__text", lines_of(F.col("__body")))
    stays = F.array_compact(F.zip_with("__text", masked(F.col("__body")), lambda x, m: F.when(~F.arrays_overlap(templates(x, m), F.col("__keys")), x)))
    kept = joined.withColumn("__kept", F.when(F.col("__keys").isNull(), F.col("__text")).otherwise(stays))
    columns = [F.array_join("__kept", "\n").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns]
    return kept.select(*columns, F.size("__text").alias(before), (F.size("__text") - F.size("__kept")).alias(dropped))


def counters(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns that line_dedup adds."""
    return fresh(docs, "__lines"), fresh(docs, "__dropped")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
parsed AS (
  SELECT doc_id, place, line,
         list_transform(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''),
                        lambda w, i: CASE WHEN regexp_matches(w, '[0-9@]') OR (i > 1 AND regexp_matches(w, '^[A-Z]')) THEN '{WILD}' ELSE w END) AS w
  FROM lines),
sized AS (SELECT *, len(w) AS n, {LEAD} + (len(w) - {LEAD}) // 2 AS cut FROM parsed),
keyed AS (
  SELECT doc_id, place, unnest(CASE WHEN n < {LEAD} OR 2 * len(list_filter(w, lambda x: x = '{WILD}')) > n THEN ['line ' || line] WHEN n >= {HALVES_FROM} THEN
           ['all ' || n || ' ' || array_to_string(w, ' '), 'front ' || n || ' ' || array_to_string(w[1:cut], ' '),
            'back ' || n || ' ' || array_to_string(list_concat(w[1:{LEAD}], w[cut + 1:n]), ' ')]
         ELSE ['all ' || n || ' ' || array_to_string(w, ' ')] END) AS key
  FROM sized WHERE n > 0),
counted AS (SELECT key, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM keyed GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT doc_id, place FROM keyed JOIN counted USING (key) WHERE doc_id > first)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '') AS text,
       count(*) AS n_lines, count(g.place) AS n_dropped
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id
"""
