"""The registered queries of the document engine, each over its whole table, and their SQL.

The SQL is written apart from the engine: it splits sentences with its own expressions and never
shares a pattern object with the code.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.shared import materialize
from prosemill.functions.spans import utf16_length
from prosemill.operators import calibration, classifier, rewrites, usability
from prosemill.operators import word_lists as L
from prosemill.operators.builtins import CHECKS
from prosemill.operators.segmentation import Segmented, segment
from prosemill.plans.check import check, findings, results, shared
from prosemill.plans.rules import rule_hits
from prosemill.sources.packs import bundled, load_bundled, parse_pack
from prosemill.streaming.incremental import changed_segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A pack of words that the test tables hold.
PACK = parse_pack(
    {
        "schemaVersion": 1,
        "packId": "catalogue",
        "version": "1",
        "policies": [
            {"id": "of-the", "version": 2, "title": "Of the", "guidance": "-", "severity": "info", "detectors": [
                {"id": "phrase", "lane": "rules", "kind": "phrase", "phrases": ["of the", "of"], "exceptions": ["of that"]},
                {"id": "better", "lane": "rules", "kind": "phrase", "phrases": ["of the"], "replacement": "of a"},
            ]},
            {"id": "tion", "version": 1, "title": "Nouns in -tion", "guidance": "-", "severity": "warn", "detectors": [
                {"id": "regex", "lane": "rules", "kind": "regex", "pattern": r"\b[a-z]+tion\b", "exceptions": [r"\bthe[a-z]*tion\b"]},
            ]},
            {"id": "off", "version": 1, "title": "Off", "guidance": "-", "severity": "error", "enabled": False, "detectors": [
                {"id": "is", "lane": "rules", "kind": "phrase", "phrases": ["is"]},
            ]},
        ],
    }
)


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Texts cost far more time than bytes: fewer files than tasks, or small shuffles that the
    optimizer would join into few tasks, are dealt out. Tables of many files are read as they lie."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if by:
        return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
    return df.repartition(tasks) if len(df.inputFiles()) < tasks else df


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def talks(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation as one document, a turn as a paragraph."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    turns = _dealt(rows, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


#: Paragraphs that hold what the built-in checks look for, and what they must leave alone.
PLANTED = [
    "In conclusion, it works. It is in conclusion a test.",
    "When it comes to doors, push. At the end of the day it closed. In today's plan it rains.",
    "First, open it. Second, close it. Third, leave.",
    "First, open it. Third, leave. Second, no.",
    "This will truly transform the work. It can transform it very well. It will very much leverage it.",
    "Everyone knows the door is open. It is proven [1] to work. It is proven to work.",
    "The test clearly shows it. Never open the door. It never would close. The always-on lamp is on. It always rains. It is always so, according to Ann.",
    "Sales rose 12% there. Sales rose 12% in 2021. Pay 3 times more. Ticket #7 took 30 times as long. We have 1500 users now. About 20 users came.",
    "The lamp was painted red. The doors are being made by hand. He was red. It has been seen there.",
    "Open the door and then close it. Press the key; hold the lamp. Read it and weep. The door and lamp.",
    "You open the door. The lamp is red.",
    "It is not uncommon to wait. Nobody said so. We don't see nothing there. It was never at all unlikely. It is not big and not impossible.",
    "The NASA plan (NASA) began. The ESA plan and the ESA lamp. The World Body (WBO) met. The WBO left. A US plan. All PCs (small ones) left.",
    "I am late. It is here, that is, not there. Do not go. That is all. We cannot see. They are not here. It is not so. You are right.",
    "A lamp, not a door. A door, not a lamp. Red, not blue.",
    "Test the lamp. The test of a lamp. A test will test it. This of that.",
    "Thing one is here. The thing is there. Reading is good.",
    "One two three four five. Six seven eight nine ten. One two three four six. Two three four five six. Six five four three two. Four two one five six.",
    "Really, it is really very big. It is really, really here. Really good.",
    "A lamp \U0001f4a1 is on. A sign \u2705 is \U0001f680\U0001f680 here.",
]


def seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, each with one more paragraph by its id."""
    texts = F.array(*map(F.lit, PLANTED))
    return talks(spark, sf).withColumn("text", F.concat("text", F.lit("\n\n"), F.get(texts, (F.col("doc_id") % len(PLANTED)).cast("int"))))


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


# --- SQL that the queries' SQL begins with -------------------------------------------------------

_ABBREVIATED = (
    "mr|mrs|ms|dr|prof|sr|jr|st|vs|cf|fig|figs|no|nos|approx|dept|est|mt|gen|gov|sen|rep|rev|lt|col|sgt|"
    r"e\.g|i\.e|a\.m|p\.m|al|ca|vol|pp|op|ed|eds"
)
_START, _RUN = r"""(^|[\s(\["“''‘])""", r"""\.[.!?…]*["''”’)\]*_]*"""


def _sentences(text: str) -> str:
    """CTEs ``para`` (doc_id, p, start, source) and ``sent`` (doc_id, p, s, start, source) of a
    relation ``text`` of doc_id, text whose paragraphs are parted by one empty line."""
    return rf"""
    WITH whole AS ({text}),
    blocks AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS b, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM whole),
    placed AS (SELECT doc_id, k, b, coalesce(sum(length(b) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM blocks),
    para AS (
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS p,
               CAST(off + length(b) - length(regexp_replace(b, '^\s+', '')) AS INTEGER) AS start, regexp_replace(regexp_replace(b, '^\s+', ''), '\s+$', '') AS source
        FROM placed WHERE regexp_matches(b, '\S')
    ),
    marked AS (
        SELECT doc_id, p, start, regexp_replace(regexp_replace(regexp_replace(
            source, '([.!?…]+["''”’)\]*_]*)(\s+["''“‘(\[*_`]*[\p{{Lu}}\p{{Nd}}])', '\1' || chr(1) || '\2', 'g'),
            '{_START}({_ABBREVIATED})({_RUN})' || chr(1), '\1\2\3', 'gi'),
            '{_START}([A-Z]|(?:[A-Za-z]\.)+[A-Za-z])({_RUN})' || chr(1), '\1\2\3', 'g') AS m
        FROM para
    ),
    parts AS (SELECT doc_id, p, start, unnest(string_split(m, chr(1))) AS x, generate_subscripts(string_split(m, chr(1)), 1) AS k FROM marked),
    laid AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id, p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM parts),
    sent AS (
        SELECT doc_id, p, CAST(k - 1 AS INTEGER) AS s, CAST(start + off + length(x) - length(ltrim(x, ' ' || chr(10))) AS INTEGER) AS start,
               trim(x, ' ' || chr(10)) AS source
        FROM laid
    )
    """


DOCS = _sentences("SELECT doc_id, text FROM documents")
TALKS = _sentences("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
_PLANTED = ", ".join("'" + t.replace("'", "''") + "'" for t in PLANTED)
SEEDED = _sentences(
    f"SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || ([{_PLANTED}])[conv_id % {len(PLANTED)} + 1] AS text "
    "FROM conversations GROUP BY conv_id"
)
#: All matches of a pattern in ``source`` with their places.
_SPANS = r"""
    cut AS (SELECT {key}, start AS s0, string_split_regex({of}, '{re}') AS gaps, regexp_extract_all({of}, '{re}') AS found FROM {rows}),
    each AS (SELECT {key}, s0, found, gaps, unnest(found) AS m, generate_subscripts(found, 1) AS k FROM cut),
    spans AS (
        SELECT {key}, m, CAST(s0 + list_sum([length(g) for g in gaps[1:k]]) + coalesce(list_sum([length(f) for f in found[1:k-1]]), 0) AS INTEGER) AS start
        FROM each
    )
"""


def _spans(re: str, rows: str = "para", key: str = "doc_id", of: str = "source") -> str:
    return _SPANS.format(re=re, rows=rows, key=key, of=of)


# --- segmentation --------------------------------------------------------------------------------


@query(DOCS + "SELECT doc_id, p, s, start, start + length(source) AS \"end\", source FROM sent")
def segment_sentences(spark, sf):
    return segment(docs(spark, sf)).sentences.select("doc_id", "p", "s", "start", "end", "source")


@query(TALKS + "SELECT doc_id, p, start, start + length(source) AS \"end\", source FROM para")
def segment_paragraphs(spark, sf):
    return segment(talks(spark, sf)).paragraphs.select("doc_id", "p", "start", "end", "source")


@query(
    TALKS
    + """, words AS (SELECT doc_id, 'p' AS k, p, -1 AS s, regexp_replace(source, '\\s+', ' ', 'g') AS t FROM para
           UNION ALL SELECT doc_id, 's', p, s, regexp_replace(source, '\\s+', ' ', 'g') FROM sent),
       based AS (SELECT *, k || '-' || substring(sha256(t), 1, 12) AS base, substring(sha256(t), 1, 16) AS text_hash FROM words),
       nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY p, s) AS n FROM based)
       SELECT doc_id, p, s, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id, text_hash FROM nth"""
)
def segment_ids(spark, sf):
    return segment(talks(spark, sf)).rows().where("kind != 'document'").select("doc_id", "p", "s", "id", "text_hash")


@query("SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM documents")
def utf16_units(spark, sf):
    return docs(spark, sf).select("doc_id", utf16_length(F.col("text")).cast("long").alias("units"))


@query()
def markdown_segments(spark, sf):
    return segment(docs(spark, sf), "markdown").rows().select("doc_id", "p", "s", "kind", "block", "start", "end", "id")


#: Texts in pieces: source, kind, the prose in it and that prose as plain text. A kind that holds prose is a block's.
MARKED = [
    [("# Head *x* #", "heading", "Head *x*", "Head x"), ("Para `a. B` here. Two.", "paragraph", "Para `a. B` here. Two.", "Para a. B here. Two."), ("```py\ncode. Code.\n```", "code", None, None), ("> Quoted. Text.", "quote", None, None)],
    [(":::note{a=1}", "directive", None, None), ("Inside **it** all.", "paragraph", "Inside **it** all.", "Inside it all."), (":::", "directive", None, None), ("::leaf{a=1\nb=2}", "directive", None, None), ("Title\n=====", "heading", "Title", "Title")],
    [("| a | b |\n|---|---|\n| 1 | 2 |", "table", None, None), ("<div>\n<b>x</b>\n</div>", "html", None, None), ("- one [link](http://x.y)", "listItem", "one [link](http://x.y)", "one link"), ("    code\n\n    more", None, "code", "code")],
    [("~~~\n```\n:::note\n~~~", "code", None, None), ("1. First. Step.", "listItem", "First. Step.", "First. Step."), ("***", "rule", None, None), ("<!-- a. B -->", "html", None, None), ("End _now_.", "paragraph", "End _now_.", "End now.")],
]
MARKED[2].pop()  # indented lines after an item go on with the item


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, each with blocks of markup by its id after it."""
    texts = F.array(*[F.lit("\n\n".join(x[0] for x in pieces)) for pieces in MARKED])
    return talks(spark, sf).withColumn("text", F.concat("text", F.lit("\n\n"), F.get(texts, (F.col("doc_id") % len(MARKED)).cast("int"))))


def _marked_values(prose: bool) -> str:
    """Rows of sample, kind, text, start, end, as the pieces say."""
    rows = []
    for k, pieces in enumerate(MARKED):
        at = 0
        for source, kind, inner, plain in pieces:
            quoted = "NULL" if plain is None else "'" + plain.replace("'", "''") + "'"
            start = at + (source.index(inner) if inner else 0)
            if (inner is not None) == prose and kind != "rule":
                rows.append(f"({k}, '{kind}', {quoted}, {start}, {start + len(inner or source)})")
            at += len(source) + 2
    return ", ".join(rows)


_MARKED_SQL = """SELECT doc_id, {names}, CAST(length(text) + 2 + a AS INTEGER) AS start, CAST(length(text) + 2 + b AS INTEGER) AS "end"
    FROM (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id) JOIN (VALUES {values}) v(sample, kind, plain, a, b) ON doc_id % {n} = sample"""


@query(_MARKED_SQL.format(names="kind", values=_marked_values(False), n=len(MARKED)))
def protected_regions(spark, sf):
    return segment(marked(spark, sf), "markus").protected


@query(_MARKED_SQL.format(names="kind AS block, plain AS text", values=_marked_values(True), n=len(MARKED)))
def markdown_blocks(spark, sf):
    """The blocks of prose that stand after the conversation."""
    rows = segment(marked(spark, sf), "markus").paragraphs.join(talks(spark, sf).select("doc_id", F.length("text").alias("own")), "doc_id")
    return rows.where("start > own").select("doc_id", "block", "text", "start", "end")


# --- rules lane ----------------------------------------------------------------------------------


_UNICODE_EDGE = r"[\p{L}\p{N}_]"
#: Hits of ``PACK`` over documents of one paragraph: word borders beside letters beyond ASCII are checked by hand.
_PACK_HITS = (
    DOCS
    + "," + _spans(r"(?i)\b(?:of\s+that|of\s+the|of)\b", key="doc_id, p")
    + rf""", cut2 AS (SELECT doc_id, p, start AS s0, string_split_regex(source, '\b[a-z]+tion\b') AS gaps, regexp_extract_all(source, '\b[a-z]+tion\b') AS found FROM para),
    each2 AS (SELECT *, unnest(found) AS m, generate_subscripts(found, 1) AS k FROM cut2),
    tion AS (SELECT doc_id, p, m, CAST(s0 + list_sum([length(g) for g in gaps[1:k]]) + coalesce(list_sum([length(f) for f in found[1:k-1]]), 0) AS INTEGER) AS start FROM each2),
    all_hits AS (
        SELECT doc_id, p, 'of-the' AS policy_id, CASE WHEN lower(m) = 'of' THEN 'phrase' ELSE 'better' END AS detector_id, start, m, CASE WHEN lower(m) = 'of' THEN NULL ELSE 'of a' END AS replacement
        FROM spans WHERE NOT regexp_matches(m, '(?i)that$')
        UNION ALL SELECT doc_id, p, 'tion', 'regex', start, m, NULL FROM tion WHERE m NOT LIKE 'the%'),
    hits AS (
        SELECT h.doc_id, policy_id, detector_id, h.start, h.start + length(m) AS "end", replacement FROM all_hits h JOIN para USING (doc_id, p)
        WHERE NOT regexp_matches(substr(source, h.start - para.start, 1), '{_UNICODE_EDGE}') AND NOT regexp_matches(substr(source, h.start - para.start + length(m) + 1, 1), '{_UNICODE_EDGE}'))
    """
)


@query(_PACK_HITS + "SELECT * FROM hits")
def pack_hits(spark, sf):
    return rule_hits(segment(docs(spark, sf)), PACK).select("doc_id", "policy_id", "detector_id", "start", "end", "replacement")


@query(TALKS + "," + _spans(r"(?i)\bthe\b", key="doc_id, p") + "SELECT doc_id, p, start, start + length(m) AS \"end\", m AS word FROM spans")
def phrase_spans(spark, sf):
    from prosemill.functions.regex import phrase_pattern, to_java
    from prosemill.functions.spans import exploded, find_spans

    rows = segment(talks(spark, sf)).paragraphs
    rows = exploded(rows, find_spans(F.col("masked"), to_java(phrase_pattern(["the"]), True)), "x")
    return rows.select("doc_id", "p", (F.col("start") + F.col("x.start")).alias("start"), (F.col("start") + F.col("x.end")).alias("end"), F.col("x.m").alias("word"))


@query()
def check_findings(spark, sf):
    return check(docs(spark, sf), PACK).select("doc_id", "id", "policy_id", "detector_id", "severity", "segment_id", "start", "end", "u16_start", "occurrence", "excerpt")


@query(
    _PACK_HITS.replace(DOCS, TALKS, 1) + """, named AS (
        SELECT doc_id, p, s, start AS s0, source AS seg, trim(regexp_replace(source, '\\s+', ' ', 'g')) AS flat FROM sent),
    numbered AS (SELECT *, 's-' || substring(sha256(flat), 1, 12) AS base, row_number() OVER (PARTITION BY doc_id, flat ORDER BY p, s) AS nth FROM named),
    inside AS (
        SELECT h.*, seg, s0, flat, base || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS segment_id, substr(seg, h.start - s0 + 1, h."end" - h.start) AS excerpt
        FROM hits h JOIN numbered n ON n.doc_id = h.doc_id AND s0 <= h.start AND h."end" <= s0 + length(seg)),
    counted AS (
        SELECT *, trim(regexp_replace(excerpt, '\\s+', ' ', 'g')) AS said,
            CAST(row_number() OVER (PARTITION BY doc_id, policy_id, detector_id, segment_id, trim(regexp_replace(excerpt, '\\s+', ' ', 'g')) ORDER BY start, "end") - 1 AS INTEGER) AS occurrence FROM inside)
    SELECT c.doc_id, 'f-' || substring(sha256(concat_ws(chr(31), policy_id, detector_id, flat, said, occurrence)), 1, 16) AS id, policy_id, detector_id,
        CASE policy_id WHEN 'tion' THEN 'warn' ELSE 'info' END AS severity, segment_id, start, "end",
        CAST(start + length(regexp_replace(substr(text, 1, start), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS INTEGER) AS u16_start, occurrence, excerpt
    FROM counted c JOIN whole USING (doc_id)"""
)
def check_findings_of_talks(spark, sf):
    return check(talks(spark, sf), PACK).select("doc_id", "id", "policy_id", "detector_id", "severity", "segment_id", "start", "end", "u16_start", "occurrence", "excerpt")


@query()
def check_results(spark, sf):
    return results(talks(spark, sf), PACK)


@query(_PACK_HITS + "SELECT policy_id, CASE policy_id WHEN 'tion' THEN 'warn' ELSE 'info' END AS severity, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM hits GROUP BY policy_id")
def findings_by_policy(spark, sf):
    found = check(docs(spark, sf), PACK)
    return found.groupBy("policy_id", "severity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("documents"))


@query(
    _PACK_HITS + """, held AS (SELECT h.doc_id, h.policy_id, h.start, h."end", bool_or(s.start <= h.start AND h."end" <= s.start + length(s.source)) AS inside FROM hits h JOIN sent s USING (doc_id) GROUP BY ALL)
    SELECT CASE WHEN inside THEN 'sentence' ELSE 'paragraph' END AS segment_kind, count(*) AS n FROM held GROUP BY 1"""
)
def located_by_kind(spark, sf):
    seg = segment(docs(spark, sf))
    return findings(rule_hits(seg, PACK), seg, PACK).groupBy("segment_kind").agg(F.count(F.lit(1)).alias("n"))


for _name in bundled():
    query(name=f"pack_{_name.replace('-', '_')}")(
        (lambda pack: lambda spark, sf: check(talks(spark, sf), load_bundled(pack)).select("doc_id", "id", "policy_id", "detector_id", "start", "end"))(_name)
    )


# --- built-in checks -----------------------------------------------------------------------------


def _check(name: str, params: dict | None = None, sql: str | None = None, of: Callable = seeded, called: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return CHECKS[name](segment(of(spark, sf)), params or {}, None).select("doc_id", "start", "end")

    query(sql, name=f"check_{called or name}")(run)


_ENDS = 'SELECT doc_id, start, start + length(source) AS "end"'
_WORDS = "len(regexp_extract_all({}, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*'))"
_CITED = r"(?i)https?://|\[[0-9]+\]|according to|\([12][0-9]{3}\)|\b20[0-9]{2}\b"
_VERBS = "SELECT unnest(string_split('{}', ' '))"
_FLAT = r"regexp_replace(source, '\s+', ' ', 'g')"

_check("empty_leadin", sql=SEEDED + _ENDS + " FROM sent WHERE regexp_matches(source, '(?i)^(?:In today''s|It is important to note|When it comes to|At the end of the day|In conclusion)\\b')")
_check("list_shaped_prose", sql=SEEDED + _ENDS + rf" FROM para WHERE regexp_matches({_FLAT}, '(?i)\bFirst,\s+.+\bSecond,\s+.+\bThird,\s+')")
_check("vague_claim", sql=SEEDED + _ENDS + rf" FROM sent WHERE regexp_matches({_FLAT}, '(?i)\b(?:very|significantly|dramatically|truly|really)\b.+\b(?:transform|revolutionize|leverage)\b')")
_check(
    "unsupported_certainty",
    sql=SEEDED + _ENDS + rf""" FROM sent WHERE NOT regexp_matches(source, '{_CITED}') AND (
        regexp_matches(source, '(?i)\b(?:everyone knows|undeniably|proven)\b') OR regexp_matches(source, '(?i)\bclearly\s+(?:shows|demonstrates|proves|will|is)\b')
        OR (regexp_matches(regexp_replace(source, '(?i)\b(?:always|never)-\w+', ' ', 'g'), '(?i)\b(?:always|never)\b')
            AND NOT regexp_matches(source, '(?i)\bnever\s+(?:had|would|could|should|might|may|will|can)\b') AND NOT regexp_matches(source, '^Never\s+\w')))""",
)
_check(
    "missing_attribution",
    sql=SEEDED + _ENDS + rf""" FROM sent WHERE NOT regexp_matches(source, '{_CITED}') AND (regexp_matches(source, '\d+(?:\.\d+)?%')
        OR (NOT regexp_matches(source, '#\d+\b') AND (regexp_matches(source, '(?i)\d+\s*[×x]\b|\d+\s+times\b')
            OR regexp_matches(source, '(?i)\b\d{{3,}}\s+(?:users|ms|seconds|minutes|hours|days|requests|tokens)\b'))))""",
)
_PARTICIPLES = (
    "made|done|given|taken|held|kept|put|set|sent|shown|known|seen|written|built|found|paid|told|brought|bought|caught|taught|thought|lost|begun|chosen|"
    "driven|eaten|forgotten|gotten|hidden|broken|spoken|stolen|worn|torn|drawn|grown|thrown|sold|shut|led|fed|laid|said|heard|meant|understood|struck|hung|won|spent|bound"
)
_check("passive_voice", sql=SEEDED + _ENDS + rf" FROM sent WHERE regexp_matches(source, '(?i)\b(?:is|are|was|were|be|been|being)\s+(?:\w+ed|{_PARTICIPLES})\b')")
_check("sentence_length", {"maxWords": 12}, SEEDED + _ENDS + f" FROM sent WHERE {_WORDS.format('source')} > 12")
_check(
    "average_sentence_length", {"maxWords": 8, "minSentences": 2},
    SEEDED + f"""SELECT doc_id, 0 AS start, CAST(max(length(text)) AS INTEGER) AS "end" FROM sent JOIN whole USING (doc_id)
        GROUP BY doc_id HAVING count(*) >= 2 AND avg({_WORDS.format('source')}) > 8""",
)
_check(
    "paragraph_length", {"maxSentences": 4, "maxWords": 30},
    SEEDED + f"""{_ENDS} FROM para WHERE (SELECT count(*) FROM sent s WHERE s.doc_id = para.doc_id AND s.p = para.p) > 4 OR {_WORDS.format('source')} > 30""",
)
_check(
    "reading_grade_level", {"maxGrade": 6, "minWords": 20},
    SEEDED + f""", w AS (SELECT doc_id, unnest(regexp_extract_all(lower(source), '[a-z0-9]+(?:[''’-][a-z0-9]+)*')) AS w FROM sent),
        y AS (SELECT doc_id, w, len(regexp_extract_all(w, '[aeiouy]+')) AS g FROM w),
        t AS (SELECT doc_id, count(*) AS n, sum(greatest(1, g - CASE WHEN regexp_matches(w, 'e$') AND NOT regexp_matches(w, '(?:le|ee|ye)$') AND g > 1 THEN 1 ELSE 0 END)) AS y FROM y GROUP BY doc_id),
        c AS (SELECT doc_id, count(*) AS s FROM sent GROUP BY doc_id)
        SELECT doc_id, 0 AS start, CAST(length(text) AS INTEGER) AS "end" FROM t JOIN c USING (doc_id) JOIN whole USING (doc_id)
        WHERE n >= 20 AND 0.39::DOUBLE * n / s + 11.8::DOUBLE * y / n - 15.59::DOUBLE > 6""",
)
_NEGATIVE = (
    r"(?:nothing|nobody|none|nowhere|neither|never|no\s+one|un(?:common|usual|likely|important|reasonable|known|clear|certain|aware|able|fair|helpful|necessary|"
    r"available|willing|wise|true|related|limited|acceptable|interesting|familiar|safe|lawful)|in(?:frequent|significant|valid|correct|consistent|appropriate|"
    r"accurate|complete|sufficient|capable)|im(?:possible|probable|proper|material)|il(?:legal|logical)|ir(?:relevant|regular|responsible)|non\w{{3,}})"
)
_check(
    "double_negative",
    sql=SEEDED + "," + _spans(rf"(?i)\b(?:not|never|no|\w+n[''’]t)\b(?:\s+\w+){{0,2}}?\s+{_NEGATIVE.replace('{{', '{').replace('}}', '}')}\b") + 'SELECT doc_id, start, start + length(m) AS "end" FROM spans',
)
_check(
    "ing_form", {"allow": ["reading"]},
    SEEDED + "," + _spans(r"\b[A-Za-z]{2,}ing\b") + """SELECT doc_id, start, start + length(m) AS "end" FROM spans WHERE lower(m) NOT IN
        (SELECT unnest(string_split('reading anything bring ceiling cling during evening everything fling king morning nothing ping pudding ring sing sling something spring sting string swing thing things wedding wing', ' ')))""",
)
_check("no_emojis", sql=SEEDED + "," + _spans(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]") + 'SELECT doc_id, start, start + length(m) AS "end" FROM spans')
_check(
    "contrast_cap", {"max": 0},
    SEEDED + "," + _spans(r"(?i),\s*not\s+\w+") + 'SELECT doc_id, start, start + length(m) AS "end" FROM spans QUALIFY count(*) OVER (PARTITION BY doc_id) > 0',
)
_check(
    "missing_article", {"nouns": ["Thing", "what", "reading"]},
    SEEDED + "," + _spans("[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*", "sent", "doc_id, p, s") + """SELECT doc_id, start, start + length(m) AS "end" FROM spans
        JOIN
        (SELECT doc_id, p, s, min(start) AS start FROM spans GROUP BY ALL) f USING (doc_id, p, s, start) WHERE lower(m) IN ('thing', 'what', 'reading')""",
)
_listed = lambda words: ", ".join(f"'{w}'" for w in words)
_WORD_SPANS = _spans("[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*", "sent", "doc_id, p, s")
_check(
    "one_meaning", {"words": [{"word": "test", "meaning": "noun"}, {"word": "of", "meaning": "verb"}]},
    SEEDED + "," + _WORD_SPANS + f""", around AS (SELECT doc_id, start, m, lower(m) AS w, lag(lower(m)) OVER o AS prior, lead(lower(m)) OVER o AS next FROM spans WINDOW o AS (PARTITION BY doc_id, p, s ORDER BY start))
        SELECT doc_id, start, start + length(m) AS "end" FROM around WHERE (w = 'of' AND prior IN ({_listed(L.DETERMINERS)}))
        OR (w = 'test' AND (prior IN ({_listed(L.VERB_MARKERS)}) OR (prior IS NULL AND next IN ({_listed(L.DETERMINERS)}))))""",
)
_check(
    "undefined_acronym", {"allow": ["GNU"]},
    SEEDED + "," + _spans(r"\b[A-Z][A-Z0-9]*[A-Z](?:s)?\b", key="doc_id, p") + f""", uses AS (
            SELECT doc_id, regexp_replace(m, 's$', '') AS name, m, s.start, substr(source, 1, s.start - para.start) AS before, substr(source, s.start - para.start + length(m) + 1) AS after
            FROM spans s JOIN para USING (doc_id, p)),
        first AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY start) AS nth FROM uses
            WHERE NOT regexp_matches(before, '{_UNICODE_EDGE}$') AND NOT regexp_matches(after, '^{_UNICODE_EDGE}') AND length(name) >= 2 AND name NOT IN ({_listed([*L.KNOWN_ACRONYMS, "GNU"])}))
        SELECT doc_id, start, start + length(m) AS "end" FROM first WHERE nth = 1
        AND NOT (regexp_matches(before, '\\(\\s*$') AND regexp_matches(after, '^\\s*\\)')) AND NOT regexp_matches(after, '^\\s*\\(\\s*[A-Za-z]')""",
)
_check(
    "multiple_instructions", {"wholeDocument": True},
    SEEDED + f""", steps AS (SELECT doc_id, start, source, unnest(string_split_regex({_FLAT}, '(?i)\\b(?:and\\s+then|and|then|or)\\b|;')) AS x,
            generate_subscripts(string_split_regex({_FLAT}, '(?i)\\b(?:and\\s+then|and|then|or)\\b|;'), 1) AS k FROM sent)
        SELECT DISTINCT doc_id, start, start + length(source) AS "end" FROM steps WHERE k > 1 AND lower(regexp_extract(x, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*')) IN ({_listed(L.IMPERATIVES)})""",
)
_check(
    "imperative_steps", {"wholeDocument": True},
    SEEDED + _ENDS + """ FROM sent WHERE s = 0 AND lower(regexp_extract(source, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*')) IN
        (SELECT unnest(string_split('you we i the a an it they he she there this that these those user users operator operators person people', ' ')))""",
)
_check(
    "redundancy",
    sql=SEEDED + """, tok AS (SELECT doc_id, p, s, start, source, regexp_extract_all(lower(source), '[a-z0-9'']+') AS t FROM sent),
        g AS (SELECT doc_id, p, s, start, source, unnest(list_distinct([array_to_string(t[i:i+3], ' ') for i in range(1, len(t) - 2)])) AS g FROM tok WHERE len(t) >= 4),
        sh AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1 AND NOT (min(lower(regexp_replace(source, '\\s+', ' ', 'g'))) = max(lower(regexp_replace(source, '\\s+', ' ', 'g')))
            AND len(string_split(min(lower(regexp_replace(source, '\\s+', ' ', 'g'))), ' ')) <= 12))
        SELECT DISTINCT doc_id, start, start + length(source) AS "end" FROM g WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM sh)""",
)
_check(
    "overused_words",
    sql=SEEDED + "," + _spans(rf"(?i)\b(?:{'|'.join(L.CRUTCH_WORDS)})\b") + f""", total AS (SELECT doc_id, sum(len(string_split({_FLAT}, ' '))) AS n FROM para GROUP BY doc_id),
        uses AS (SELECT doc_id, lower(m) AS w, count(*) AS k, min(start) AS start FROM spans GROUP BY ALL)
        SELECT doc_id, start, start + length(w) AS "end" FROM uses JOIN total USING (doc_id) WHERE k > greatest(3, round_even(n / 250, 0))""",
)
_BEFORE_NOT = "do|does|did|can|will|would|should|could|is|are|was|were|have|has|had"
_check(
    "uncontracted_forms",
    sql=SEEDED + f""", {_spans(r"(?i)\b(?:(?:that|it|there|who|what) is|(?:they|we|you) are|i am|let us)\b", key="doc_id, p")},
        second AS (SELECT doc_id, p, start AS s0, string_split_regex(source, '(?i)\\b(?:cannot|(?:{_BEFORE_NOT}) not)\\b') AS gaps, regexp_extract_all(source, '(?i)\\b(?:cannot|(?:{_BEFORE_NOT}) not)\\b') AS found FROM para),
        split AS (SELECT *, unnest(found) AS m, generate_subscripts(found, 1) AS k FROM second),
        nots AS (SELECT doc_id, p, m, CAST(s0 + list_sum([length(g) for g in gaps[1:k]]) + coalesce(list_sum([length(f) for f in found[1:k-1]]), 0) AS INTEGER) AS start FROM split),
        forms AS (
            SELECT s.doc_id, s.start, s.start + length(m) AS "end", CASE WHEN lower(m) LIKE '% is' THEN 1 ELSE 3 END AS ord
            FROM spans s JOIN para USING (doc_id, p) WHERE NOT (lower(m) = 'that is' AND substr(source, s.start - para.start + length(m) + 1, 1) = ',')
            UNION ALL SELECT doc_id, start, start + length(m), 2 FROM nots)
        SELECT doc_id, start, "end" FROM forms b WHERE NOT EXISTS (SELECT 1 FROM forms o WHERE o.doc_id = b.doc_id AND o.ord < b.ord AND o.start < b."end" AND b.start < o."end")""",
)
_check(
    "uniform_cadence",
    sql=SEEDED.replace("WITH whole", "WITH RECURSIVE whole", 1) + f""", num AS (
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, s) AS i, start, start + length(source) AS "end", len(string_split({_FLAT}, ' ')) AS n FROM sent),
        ends AS (
            SELECT a.doc_id, a.i, coalesce(min(b.i), (SELECT max(i) + 1 FROM num c WHERE c.doc_id = a.doc_id)) AS e
            FROM num a LEFT JOIN num b ON b.doc_id = a.doc_id AND b.i > a.i AND abs(b.n - a.n) > 3 GROUP BY a.doc_id, a.i),
        walk AS (SELECT DISTINCT doc_id, 1::BIGINT AS i FROM num UNION ALL SELECT doc_id, CASE WHEN e - i >= 5 THEN e ELSE i + 1 END FROM walk JOIN ends USING (doc_id, i))
        SELECT w.doc_id, f.start, l."end" FROM walk w JOIN ends x ON x.doc_id = w.doc_id AND x.i = w.i AND e - x.i >= 5
        JOIN num f ON f.doc_id = w.doc_id AND f.i = w.i JOIN num l ON l.doc_id = w.doc_id AND l.i = e - 1""",
)
_check(
    "information_density", {"minWords": 20, "minLexicalDensity": 0.6, "maxGzipRatio": 0.0},
    SEEDED + f""", t AS (SELECT doc_id, unnest(regexp_extract_all(lower(source), '[a-z0-9'']+')) AS t FROM para)
        SELECT doc_id, 0 AS start, CAST(any_value(length(text)) AS INTEGER) AS "end" FROM t JOIN whole USING (doc_id) GROUP BY doc_id
        HAVING count(*) >= 20 AND count_if(t NOT IN ({_listed(L.FUNCTION_WORDS)})) / count(*)::DOUBLE < 0.6""",
    called="lexical_density",
)
_check("information_density", {"minWords": 20, "minLexicalDensity": 0.6})


# --- classifier lane and calibration -------------------------------------------------------------


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a made-up probability that depends on the id alone."""
    rows = spark.read.parquet(f"{sf}/labels.parquet")
    return rows.select("doc_id", (F.col("doc_id") * 37 % 101 / F.lit(100.0)).alias("probability"), (F.col("quality") == 0).alias("violates"), F.concat(F.lit("d"), F.col("doc_id") % 3).alias("detector_id"))


_LABELLED = "SELECT doc_id, (doc_id * 37 % 101) / 100.0::DOUBLE AS probability, quality = 0 AS violates, 'd' || (doc_id % 3) AS detector_id FROM labels"


@query()
def calibrate_detectors(spark, sf):
    return calibration.calibrate(_labelled(spark, sf).withColumn("policy_id", F.lit("p")))


@query(f"WITH l AS ({_LABELLED}) SELECT doc_id, round(1 / (1 + exp(-(1.5 * ln(q / (1 - q)) - 0.25))), 6) AS calibrated FROM (SELECT *, greatest(least(probability, 1 - 1e-6), 1e-6) AS q FROM l)")
def platt_probabilities(spark, sf):
    out = calibration.apply_platt(F.col("probability"), F.lit(1.5), F.lit(-0.25))
    return _labelled(spark, sf).select("doc_id", F.round(out, 6).alias("calibrated"))


@query(
    f"""WITH l AS ({_LABELLED}) SELECT doc_id, round(CASE WHEN probability <= 0.2 THEN 0.1 WHEN probability >= 0.8 THEN 0.9
        WHEN probability <= 0.5 THEN 0.1 + (0.3 - 0.1) * (probability - 0.2) / (0.5 - 0.2) ELSE 0.3 + (0.9 - 0.3) * (probability - 0.5) / (0.8 - 0.5) END, 6) AS calibrated FROM l"""
)
def isotonic_probabilities(spark, sf):
    points = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.2, 0.1), (0.5, 0.3), (0.8, 0.9))])
    return _labelled(spark, sf).select("doc_id", F.round(calibration.apply_isotonic(F.col("probability"), points), 6).alias("calibrated"))


@query(
    f"""WITH l AS ({_LABELLED}), b AS (SELECT detector_id, least(floor(probability * 10), 9) AS bin, count(*) AS n, sum(probability) AS p, sum(violates::INT) AS y FROM l GROUP BY ALL)
        SELECT detector_id, round(sum(abs(p - y)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY detector_id"""
)
def calibration_error(spark, sf):
    return calibration.calibration_error(_labelled(spark, sf), keys=("detector_id",)).select("detector_id", F.round("ece", 6).alias("ece"), "n")


QUESTION_PACK = parse_pack(
    {
        "schemaVersion": 1,
        "packId": "questions",
        "version": "1",
        "policies": [
            {"id": "hype", "version": 1, "title": "Hype", "guidance": "-", "severity": "warn", "detectors": [
                {"id": "s", "lane": "classifier", "scope": "sentence", "question": {"type": "noul", "instructions": "Hype?"}, "violation": {"answer": "yes"}, "threshold": 0.8, "reviewAt": 0.5},
                {"id": "d", "lane": "classifier", "scope": "document", "question": {"type": "choice", "criteria": ["promo", "plain"]}, "violation": {"labels": ["promo"]}, "threshold": 0.6},
            ]},
        ],
    }
)


def stand_in_model(batch: pd.DataFrame) -> list[str]:
    """A model for tests: sure where the target holds "ing", undecided where it holds "tion"."""
    p = [0.9 if "ing" in t else 0.6 if "tion" in t else 0.1 for t in batch["target"]]
    return [json.dumps({"hype__s": {"noul": x}, "hype__d": {"probabilities": {"promo": x, "plain": 1 - x}}}) for x in p]


_JUDGED = """, j AS (SELECT doc_id, 's' AS detector_id, start, regexp_replace(source, '\\s+', ' ', 'g') AS t, 0.8 AS hi, 0.5 AS lo FROM sent
    UNION ALL SELECT doc_id, 'd', 0, text, 0.6, NULL FROM whole),
    q AS (SELECT *, CASE WHEN contains(t, 'ing') THEN 0.9 WHEN contains(t, 'tion') THEN 0.6 ELSE 0.1 END AS x FROM j)"""


@query(TALKS + _JUDGED + "SELECT doc_id, detector_id, start, x::DOUBLE AS probability, CASE WHEN x >= hi THEN 'violation' WHEN x >= lo THEN 'review' END AS status FROM q")
def classifier_coverage(spark, sf):
    rows = classifier.jobs(segment(talks(spark, sf)), QUESTION_PACK)
    answers = classifier.ask(rows, stand_in_model)
    return classifier.judged(rows, answers, QUESTION_PACK).select("doc_id", "detector_id", "start", "probability", "status")


@query(TALKS + "SELECT doc_id, count(*) + 1 AS jobs FROM sent GROUP BY doc_id")
def classifier_jobs(spark, sf):
    return classifier.jobs(segment(talks(spark, sf)), QUESTION_PACK).groupBy("doc_id").agg(F.count(F.lit(1)).alias("jobs"))


def failing_model(batch: pd.DataFrame) -> list[str]:
    """The stand-in, out of order for targets that hold "the"."""
    if any("the" in t for t in batch["target"]):
        raise RuntimeError("out of order")
    return stand_in_model(batch)


@query(
    TALKS + """, j AS (SELECT doc_id, contains(regexp_replace(source, '\\s+', ' ', 'g'), 'the') AS bad FROM sent
        UNION ALL SELECT doc_id, bool_or(contains(regexp_replace(source, '\\s+', ' ', 'g'), 'the')) FROM para GROUP BY doc_id),
    c AS (SELECT doc_id, count(*) AS n, count_if(bad) AS failed FROM j GROUP BY doc_id)
    SELECT doc_id, CASE WHEN failed = n THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'ran' END AS status,
        CASE WHEN failed = n THEN 'RuntimeError: out of order' WHEN failed > 0 THEN failed || ' request(s) failed: RuntimeError: out of order' END AS reason, n - failed AS requests FROM c"""
)
def lane_status(spark, sf):
    return classifier.run_lane(segment(talks(spark, sf)), QUESTION_PACK, failing_model).status.select("doc_id", "status", "reason", "requests")


_ASKED = {scope: len(json.dumps(classifier.questions(QUESTION_PACK, scope, "paragraph"), sort_keys=True, ensure_ascii=False)) for scope in ("sentence", "document")}


@query(
    TALKS + f""", flat AS (SELECT doc_id, p, {_FLAT} AS t FROM para),
    j AS (SELECT doc_id, 0 AS rank, p, s, CAST(ceil((length(regexp_replace(source, '\\s+', ' ', 'g')) + length(t) + {_ASKED['sentence']}) / 4) AS BIGINT) AS tokens FROM sent JOIN flat USING (doc_id, p)
        UNION ALL SELECT doc_id, 2, -1, -1, CAST(ceil((sum(length(t)) + 2 * (count(*) - 1) + {_ASKED['document']}) / 4) AS BIGINT) FROM flat GROUP BY doc_id),
    r AS (SELECT doc_id, tokens, CAST(row_number() OVER o AS INTEGER) AS ord, CAST(sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM j WINDOW o AS (PARTITION BY doc_id ORDER BY rank, p, s))
    SELECT doc_id, ord, tokens, spent, spent <= 500 AS asked FROM r"""
)
def budget_prefix(spark, sf):
    return classifier.within_budget(classifier.jobs(segment(talks(spark, sf)), QUESTION_PACK), 500).select("doc_id", "ord", "tokens", "spent", "asked")


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS target_id, 'd' || (turn % 2) AS detector_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM conversations),
    e AS (SELECT DISTINCT 'd' || (item_id % 2) AS detector_id, text AS example, item_id % 3 = 0 AS violates, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM benchmark),
    x AS (SELECT target_id, detector_id, example, violates, len(list_intersect(t.w, e.w)) AS c, len(t.w) + len(e.w) AS n FROM t JOIN e USING (detector_id) WHERE t.text <> example),
    r AS (SELECT *, CASE WHEN c = 0 THEN 0 ELSE c / (n - c)::DOUBLE END AS f FROM x)
    SELECT target_id, 'p' AS policy_id, detector_id, CAST(row_number() OVER o AS INTEGER) AS rank, example, violates, round(f, 9) AS similarity FROM r
    WINDOW o AS (PARTITION BY target_id, detector_id ORDER BY f DESC, example, violates) QUALIFY row_number() OVER o <= 4"""
)
def few_shot_top_k(spark, sf):
    keyed = lambda df, k: df.withColumns({"policy_id": F.lit("p"), "detector_id": F.concat(F.lit("d"), F.col(k) % 2)})
    targets = keyed(spark.read.parquet(f"{sf}/conversations.parquet"), "turn").withColumn("target_id", F.col("conv_id") * 1000 + F.col("turn"))
    library = keyed(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id").withColumn("violates", F.col("item_id") % 3 == 0)
    found = classifier.few_shot(targets, library)
    return found.withColumn("similarity", F.round("similarity", 9))


@query(
    TALKS + _JUDGED + """, hit AS (SELECT doc_id, detector_id, CASE WHEN x >= hi THEN 'violation' ELSE 'review' END AS status FROM q WHERE x >= hi OR x >= lo)
    SELECT doc_id, 'classifier' AS lane, 'hype' AS policy_id, detector_id, CASE detector_id WHEN 's' THEN 'sentence' ELSE 'document' END AS segment_kind, status, count(*) AS n FROM hit GROUP BY ALL"""
)
def classifier_findings(spark, sf):
    seg = segment(talks(spark, sf))
    lane = classifier.run_lane(seg, QUESTION_PACK, stand_in_model)
    found = findings(rule_hits(seg, QUESTION_PACK), seg, QUESTION_PACK, lane.hits)
    return found.groupBy("doc_id", "lane", "policy_id", "detector_id", "segment_kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    TALKS + """, now AS (SELECT doc_id, substring(sha256(regexp_replace(source, '\\s+', ' ', 'g')), 1, 16) AS h FROM sent)
        SELECT doc_id, count(DISTINCT h) AS changed FROM now WHERE h NOT IN (SELECT h FROM now WHERE doc_id % 2 = 0) GROUP BY doc_id"""
)
def incremental_changed(spark, sf):
    now = segment(talks(spark, sf)).rows().where("kind = 'sentence'")
    return changed_segments(now, now.where("doc_id % 2 = 0")).groupBy("doc_id").agg(F.count_distinct("text_hash").alias("changed"))


# --- proposed rewrites ---------------------------------------------------------------------------


@query()
def rewrite_verdicts(spark, sf):
    """Each finding of the pack with four options: the text as it is, one that mends it, that again, and bad advice."""
    seg = shared(segment(talks(spark, sf)))
    found = findings(rule_hits(seg, PACK), seg, PACK)
    asked = found.select("doc_id", F.xxhash64("doc_id", "policy_id", "detector_id", "start").alias("request_id"), "start", "end", "policy_id", "detector_id", "excerpt")
    # Options and their verdicts read it again and again: a plan that held it each time would be too large for the driver.
    wanted = materialize(rewrites.targets(asked, seg), "targets")
    said = [(F.col("target"), ""), (F.lit("Shorter."), ""), (F.lit("Shorter. "), ""), (F.lit("Longer."), "add some slang")]
    each = F.posexplode(F.array(*[F.struct(r.alias("replacement"), F.lit(why).alias("rationale")) for r, why in said])).alias("ord", "o")
    options = wanted.where("problem is null").select("request_id", "target", each).select("request_id", "ord", "o.replacement", "o.rationale")
    return rewrites.judged(options, wanted, seg, PACK, segment, by_block=True)


# --- pages ---------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with elements that depend on the id alone: some without a language, with pictures,
    small buttons and coloured text."""
    rows, k = _dealt(spark.read.parquet(f"{sf}/pages.parquet")), F.col("page_id")
    html = F.when(k % 3 == 0, F.regexp_replace("html", r'<html lang="[a-z]+">', "<html>")).otherwise(F.col("html"))
    extra = F.concat(
        F.when(k % 2 == 0, '<img src="a.png">').otherwise('<img src="a.png" alt="a">'),
        F.format_string('<button style="width:%dpx;height:30px">x</button>', k % 40),
        F.when(k % 5 == 0, '<p style="color:#777777;background-color:#ffffff">low</p>').otherwise('<p style="color:#000;background-color:#fff">high</p>'),
    )
    return rows.select("page_id", F.replace(html, F.lit("</body>"), F.concat(extra, F.lit("</body>"))).alias("html"))


@query(
    """WITH p AS (SELECT page_id, contains(html, '</body>') AS has, regexp_matches(html, '<html lang="[a-z]+">') AS lang FROM pages)
    SELECT page_id, 'missing_lang' AS kind FROM p WHERE page_id % 3 = 0 AND lang
    UNION ALL SELECT page_id, 'missing_alt' FROM p WHERE has AND page_id % 2 = 0
    UNION ALL SELECT page_id, 'small_tap_target' FROM p WHERE has AND page_id % 40 < 24
    UNION ALL SELECT page_id, 'low_contrast' FROM p WHERE has AND page_id % 5 = 0"""
)
def usability_findings(spark, sf):
    return usability.scan(_pages(spark, sf)).select("page_id", "kind")


@query()
def page_elements(spark, sf):
    return usability.nodes(spark.read.parquet(f"{sf}/pages.parquet")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def segmented_documents(spark: SparkSession, sf: str) -> Segmented:
    return segment(docs(spark, sf))
