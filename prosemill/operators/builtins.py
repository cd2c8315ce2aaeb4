"""The 24 built-in checks: each from a segmented corpus to rows of
``doc_id, start, end, message, replacement``.

Sentence and paragraph checks are one projection with one explode. Document checks aggregate by
``doc_id``, combined before the shuffle. ``blocks`` keeps paragraphs and sentences of these kinds.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.regex import to_java
from prosemill.functions.spans import exploded, find_spans, let, normalized
from prosemill.operators import word_lists as L
from prosemill.operators.segmentation import Segmented

Check = Callable[[Segmented, dict, "list[str] | None"], DataFrame]
CHECKS: dict[str, Check] = {}


def check(name: str) -> Callable[[Check], Check]:
    def put(f: Check) -> Check:
        CHECKS[name] = f
        return f

    return put


def _of(rows: DataFrame, blocks: list[str] | None) -> DataFrame:
    return rows if blocks is None else rows.where(F.col("block").isin(blocks))


def _hits(rows: DataFrame, message: Column, start: Column | str = "start", end: Column | str = "end", replacement: Column | None = None) -> DataFrame:
    of = lambda c: F.col(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")
    return rows.select("doc_id", of(start).cast("int").alias("start"), of(end).cast("int").alias("end"), message.alias("message"), (none if replacement is None else replacement).alias("replacement"))


def has(text: Column, pattern: str) -> Column:
    """Ignoring case."""
    return text.rlike(to_java(pattern, True))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(L.WORD))


def first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, L.WORD, 0))


def _exploded(rows: DataFrame, spans: Column) -> DataFrame:
    """A row a span; ``start`` and ``end`` in the document, ``m`` the text, ``at`` in the segment."""
    rows = exploded(rows, spans, "span")
    return rows.withColumns({"at": F.col("span.start"), "m": F.col("span.m"), "end": F.col("start") + F.col("span.end"), "start": F.col("start") + F.col("span.start")})


# --- sentences -----------------------------------------------------------------------------------


def certain(text: Column) -> Column:
    always = has(F.regexp_replace(text, to_java(L.ALWAYS_HYPHEN, True), " "), L.ALWAYS)
    excused = has(text, L.NEVER_MODAL) | text.rlike(to_java(L.NEVER_FIRST))
    return has(text, L.CERTAIN) | has(text, L.CLEARLY) | (always & ~excused)


def claims_number(text: Column) -> Column:
    percent = text.rlike(to_java(L.PERCENT))
    claim = percent | has(text, L.MULTIPLIER) | has(text, L.COUNTED)
    return claim & ~(text.rlike(to_java(L.STICKER)) & ~percent)


_cited = lambda: has(F.col("source"), L.CITED)
#: Predicates of a sentence, and what is said of it.
SENTENCE_CHECKS: dict[str, tuple[Callable[[], Column], str]] = {
    "empty_leadin": (lambda: has(F.col("text"), "^(?:" + "|".join(L.LEAD_INS) + r")\b"), "The sentence opens with words that say nothing yet."),
    "vague_claim": (lambda: has(F.col("text"), L.VAGUE), "An intensifier and a vague verb of change stand for a claim."),
    "unsupported_certainty": (lambda: certain(F.col("text")) & ~_cited(), "The sentence is certain without saying on what grounds."),
    "missing_attribution": (lambda: claims_number(F.col("text")) & ~_cited(), "A number is claimed without a source."),
    "passive_voice": (lambda: has(F.col("text"), L.PASSIVE), "The sentence is in the passive voice."),
}


def _sentence_check(holds: Callable[[], Column], message: str) -> Check:
    return lambda seg, params, blocks: _hits(_of(seg.sentences, blocks).where(holds()), F.lit(message))


for _name, (_holds, _message) in SENTENCE_CHECKS.items():
    CHECKS[_name] = _sentence_check(_holds, _message)


def _verbs(params: dict) -> list[str]:
    return sorted({*L.IMPERATIVES, *(v.lower() for v in params.get("imperativeVerbs") or ())})


def procedure(params: dict, blocks: list[str] | None) -> Column:
    """Is this sentence an instruction: in a list item, or in a paragraph that begins with one?"""
    begins = (F.col("block") == "paragraph") & first_word(F.col("p_text")).isin(_verbs(params))
    return (F.col("block") == "listItem") | begins


def _on_topic(rows: DataFrame, topic: str, params: dict, blocks: list[str] | None) -> DataFrame:
    return rows if topic == "any" else rows.where(procedure(params, blocks) == (topic == "procedure"))


@check("sentence_length")
def sentence_length(seg, params, blocks):
    rows = _on_topic(_of(seg.sentences, blocks), params.get("topic", "any"), params, blocks)
    rows = rows.withColumn("words", count_words(F.col("text"))).where(F.col("words") > params["maxWords"])
    return _hits(rows, F.format_string(f"%d words in a sentence; {params['maxWords']} is the limit.", "words"))


@check("multiple_instructions")
def multiple_instructions(seg, params, blocks):
    rows = _of(seg.sentences, blocks)
    rows = rows if params.get("wholeDocument") else _on_topic(rows, "procedure", params, blocks)
    parts = F.split(F.col("text"), to_java(L.SPLIT_STEPS, True), -1)
    later = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return _hits(rows.where(F.exists(later, lambda p: first_word(p).isin(_verbs(params)))), F.lit("Give each step one instruction."))


@check("imperative_steps")
def imperative_steps(seg, params, blocks):
    rows = _of(seg.sentences, blocks).where("s = 0")
    rows = rows if params.get("wholeDocument") else rows.where("block = 'listItem'")
    return _hits(rows.where(first_word(F.col("text")).isin(L.SUBJECTS)), F.lit("Begin the step with its verb."))


@check("missing_article")
def missing_article(seg, params, blocks):
    word = find_spans(F.col("masked"), L.WORD)
    rows = _exploded(_of(seg.sentences, blocks), F.slice(word, 1, 1))
    return _hits(rows.where(F.lower("m").isin([n.lower() for n in params["nouns"]])), F.format_string("Put an article before '%s'.", "m"))


@check("one_meaning")
def one_meaning(seg, params, blocks):
    meanings = {e["word"].lower(): e["meaning"] for e in params["words"]}
    spans = let(find_spans(F.col("masked"), L.WORD), lambda w: F.transform(w, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), F.lower(F.get(w, i - 1)["m"]).alias("before"), F.lower(F.get(w, i + 1)["m"]).alias("after"))))
    rows = _exploded(_of(seg.sentences, blocks), spans).withColumns({"before": F.col("span.before"), "after": F.col("span.after")})
    is_a = lambda kind: F.lower("m").isin([w for w, m in meanings.items() if m == kind])
    among = lambda c, words: F.coalesce(F.col(c).isin(words), F.lit(False))
    verb = is_a("verb") & among("before", L.DETERMINERS)
    noun = is_a("noun") & (among("before", L.VERB_MARKERS) | ((F.col("span.start") == F.col("first")) & among("after", L.DETERMINERS)))
    rows = rows.withColumn("first", F.when(F.col("before").isNull(), F.col("span.start")))
    kind = F.when(verb, "verb").when(noun, "noun")
    return _hits(rows.where(kind.isNotNull()), F.format_string("'%s' is a %s only.", F.col("m"), kind))


# --- paragraphs ----------------------------------------------------------------------------------


@check("list_shaped_prose")
def list_shaped_prose(seg, params, blocks):
    return _hits(_of(seg.paragraphs, blocks).where(has(F.col("text"), L.ENUMERATED)), F.lit("The paragraph is a list written as prose."))


@check("paragraph_length")
def paragraph_length(seg, params, blocks):
    most_sentences, most_words = params.get("maxSentences"), params.get("maxWords")
    rows = _of(seg.paragraphs, blocks).withColumn("words", count_words(F.col("text")))
    said = F.lit(None).cast("string")
    if most_words is not None:
        said = F.when(F.col("words") > most_words, F.format_string(f"%d words in a paragraph; {most_words} is the limit.", "words"))
    if most_sentences is not None:
        said = F.when(F.col("n_sentences") > most_sentences, F.format_string(f"%d sentences in a paragraph; {most_sentences} is the limit.", "n_sentences")).otherwise(said)
    return _hits(rows.where(said.isNotNull()), said)


@check("double_negative")
def double_negative(seg, params, blocks):
    return _hits(_exploded(_of(seg.paragraphs, blocks), find_spans(F.col("masked"), to_java(L.DOUBLE_NEGATIVE, True))), F.lit("Two negatives: say it positively."))


@check("ing_form")
def ing_form(seg, params, blocks):
    allowed = sorted({*L.ING_NOUNS, *(w.lower() for w in params.get("allow") or ())})
    rows = _exploded(_of(seg.paragraphs, blocks), find_spans(F.col("masked"), to_java(L.ING)))
    return _hits(rows.where(~F.lower("m").isin(allowed)), F.format_string("'%s' is an -ing form.", "m"))


@check("no_emojis")
def no_emojis(seg, params, blocks):
    return _hits(_exploded(_of(seg.paragraphs, blocks), find_spans(F.col("source"), L.EMOJI)), F.lit("An emoji stands in the text."), replacement=F.lit(""))


def _with_short(short: str) -> Callable[[Column], Column]:
    """A span with what it contracts to, a capital kept."""

    def put(s: Column) -> Column:
        capital = F.substr(s["m"], F.lit(1), F.lit(1)).rlike(r"\p{Lu}")
        to = F.when(capital, short[0].upper() + short[1:]).otherwise(F.lit(short))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), to.alias("to"))

    return put


@check("uncontracted_forms")
def uncontracted_forms(seg, params, blocks):
    """Pairs come in order; a form that overlaps one that an earlier pair took is left alone."""
    taken = F.array().cast("array<struct<start:int,end:int,m:string,to:string>>")
    free = lambda acc, x: ~F.exists(acc, lambda t: (x["start"] < t["end"]) & (t["start"] < x["end"]))
    every = []
    for formal, short in L.CONTRACTIONS:
        found = find_spans(F.col("masked"), to_java(rf"\b{formal}\b", True))
        if formal == "that is":  # with a comma it means "namely"
            found = F.filter(found, lambda s: F.substr(F.col("masked"), s["end"] + 1, F.lit(1)) != ",")
        every.append(F.transform(found, _with_short(short)))
    kept = F.aggregate(F.flatten(F.array(*every)), taken, lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    rows = _exploded(_of(seg.paragraphs, blocks), kept)
    return _hits(rows, F.format_string("'%s' could be '%s'.", F.col("m"), F.col("span.to")), replacement=F.col("span.to"))


# --- documents -----------------------------------------------------------------------------------


def _whole(rows: DataFrame, seg: Segmented, message: Column) -> DataFrame:
    """Hits on whole documents, for rows of ``doc_id`` and what the message needs."""
    ends = seg.nested.select("doc_id", F.length("text").alias("doc_end"))
    return _hits(rows.join(ends, "doc_id"), message, F.lit(0), "doc_end")


@check("average_sentence_length")
def average_sentence_length(seg, params, blocks):
    per = _of(seg.sentences, blocks).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(count_words(F.col("text"))).alias("words"))
    per = per.withColumn("mean", F.col("words") / F.col("n")).where((F.col("n") >= params.get("minSentences", 1)) & (F.col("mean") > params["maxWords"]))
    return _whole(per, seg, F.format_string(f"%.1f words in a sentence on average; {params['maxWords']} is the aim.", "mean"))


def syllables(word: Column) -> Column:
    groups = F.regexp_count(word, F.lit(L.VOWELS))
    silent = word.rlike("e$") & ~word.rlike("(?:le|ee|ye)$") & (groups > 1)
    return F.greatest(groups - silent.cast("int"), F.lit(1))


@check("reading_grade_level")
def reading_grade_level(seg, params, blocks):
    words = F.regexp_extract_all(F.lower("text"), F.lit(L.WORD), F.lit(0))
    sums = F.aggregate(words, F.lit(0), lambda acc, w: acc + syllables(w))
    per = _of(seg.sentences, blocks).groupBy("doc_id").agg(F.count(F.lit(1)).alias("s"), F.sum(F.size(words)).alias("w"), F.sum(sums).alias("y"))
    grade = 0.39 * F.col("w") / F.col("s") + 11.8 * F.col("y") / F.col("w") - 15.59
    per = per.where(F.col("w") >= max(1, params.get("minWords", 100))).withColumn("grade", grade).where(F.col("grade") > params["maxGrade"])
    return _whole(per, seg, F.format_string(f"Reads at grade %.1f; {params['maxGrade']} is the aim.", "grade"))


@check("information_density")
def information_density(seg, params, blocks):
    """Share of words that carry content, and how far the text compresses."""
    rows = _of(seg.paragraphs, blocks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", "text"))).alias("ps"))
    prose = F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n")
    tokens = F.regexp_extract_all(F.lower(prose), F.lit(L.TOKEN), F.lit(0))
    rows = rows.select("doc_id", prose.alias("prose"), F.size(tokens).alias("n"), F.size(F.filter(tokens, lambda t: ~t.isin(L.FUNCTION_WORDS))).alias("content"))
    rows = rows.where(F.col("n") >= params.get("minWords", 400)).withColumn("density", F.col("content") / F.greatest("n", F.lit(1)))
    least, most = params.get("minLexicalDensity", 0.45), params.get("maxGzipRatio", 0.35)
    thin = _whole(rows.where(F.col("density") < least), seg, F.format_string(f"Lexical density %.3f is below {least:.3f}.", "density"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py().encode() for t in batch.column("prose")]
            ratios = [len(gzip.compress(x)) / len(x) if x else 1.0 for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ratios, pa.float64())], names=["doc_id", "ratio"])

    ratios = rows.select("doc_id", "prose").mapInArrow(run, "doc_id long, ratio double")
    same = _whole(ratios.where(F.col("ratio") <= most), seg, F.format_string(f"The text repeats itself: it compresses to %.3f, at most {most:.3f}.", "ratio"))
    return thin.unionByName(same)


@check("overused_words")
def overused_words(seg, params, blocks):
    rows = _of(seg.paragraphs, blocks)
    n = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    uses = [F.regexp_count(F.col("text"), F.lit(to_java(rf"\b{w}\b", True))) for w in L.CRUTCH_WORDS]
    firsts = [F.get(find_spans(F.col("masked"), to_java(rf"\b{w}\b", True)), F.lit(0)) for w in L.CRUTCH_WORDS]
    place = lambda f: F.when(f.isNotNull(), F.struct(F.col("p"), (F.col("start") + f["start"]).alias("start"), (F.col("start") + f["end"]).alias("end")))
    per = rows.select("doc_id", n.alias("n"), *[u.alias(f"u{k}") for k, u in enumerate(uses)], *[place(f).alias(f"f{k}") for k, f in enumerate(firsts)])
    per = per.groupBy("doc_id").agg(F.sum("n").alias("total"), *[F.sum(f"u{k}").alias(f"u{k}") for k in range(len(uses))], *[F.min(f"f{k}").alias(f"f{k}") for k in range(len(uses))])
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"u{k}").alias("uses"), F.col(f"f{k}").alias("f")) for k, w in enumerate(L.CRUTCH_WORDS)])
    per = exploded(per.select("doc_id", "total", words.alias("words")), F.col("words"), "x")
    limit = F.greatest(F.lit(3), F.bround(F.greatest("total", F.lit(1)) / 250))
    hit = per.where((F.col("x.uses") > limit) & F.col("x.f").isNotNull())
    return _hits(hit, F.format_string("'%s' stands %d times in %d words.", F.col("x.word"), F.col("x.uses"), F.col("total")), F.col("x.f.start"), F.col("x.f.end"))


@check("contrast_cap")
def contrast_cap(seg, params, blocks):
    rows = _exploded(_of(seg.paragraphs, blocks), find_spans(F.col("masked"), to_java(L.CONTRAST, True)))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where(F.col("n") > params["max"])
    return _hits(rows, F.format_string(f"%d contrasts of the kind 'this, not that'; {params['max']} is the limit.", "n"))


@check("undefined_acronym")
def undefined_acronym(seg, params, blocks):
    rows = _exploded(_of(seg.paragraphs, blocks), find_spans(F.col("masked"), to_java(L.ACRONYM)))
    name = F.regexp_replace("m", "s$", "")
    before, after = F.substr("masked", F.lit(1), F.col("at")), F.substr("masked", F.col("span.end") + 1, F.length("masked"))
    inside = before.rlike(r"(?U)\(\s*\z") & after.rlike(r"(?U)^\s*\)")
    rows = rows.withColumns({"name": name, "defined": inside | after.rlike(r"(?U)^\s*\(\s*[A-Za-z]")})
    rows = rows.where(~F.col("name").isin(sorted({*L.KNOWN_ACRONYMS, *(params.get("allow") or ())})) & (F.length("name") >= 2))
    first = rows.withColumn("use", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("start"))).where("use = 1 and not defined")
    return _hits(first, F.format_string("Say what %s stands for where it comes first.", "name"))


@check("redundancy")
def redundancy(seg, params, blocks):
    """Sentences that share four words in a row with another one of the document."""
    rows = _of(seg.sentences, blocks).where("block != 'heading' and container is null")
    # A word counts if masking left it alone; words in emphasis are quoted on purpose.
    emphasis = find_spans(F.col("source"), r"(?Us)(?<![*_\w])(?:\*(?!\*).+?(?<!\*)\*|_(?!_).+?(?<!_)_)(?![*_\w])")
    words = F.filter(find_spans(F.col("masked"), L.TOKEN), lambda t: F.substr("source", t["start"] + 1, t["end"] - t["start"]) == t["m"])

    def grams(w: Column, quoted: Column) -> Column:
        four = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 3, F.lit(0))),
            lambda t, i: F.struct(t["start"].alias("start"), F.get(w, i + 3)["end"].alias("end"), F.lower(F.array_join(F.transform(F.slice(w, i + 1, F.lit(4)), lambda x: x["m"]), " ")).alias("m")),
        )
        return F.filter(four, lambda g: ~F.exists(quoted, lambda e: (e["start"] < g["start"]) & (g["end"] < e["end"])))

    # Spans of emphasis are bound before the loop over the words.
    found = let(emphasis, lambda e: let(words, lambda w: grams(w, e)))
    rows = rows.withColumn("grams", F.array_distinct(F.transform(found, lambda g: g["m"])))
    parts = exploded(rows.select("doc_id", "p", "s", normalized(F.lower("text")).alias("said"), "grams"), F.col("grams"), "gram").drop("grams")
    shared = parts.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"), F.min("said").alias("a"), F.max("said").alias("b"))
    refrain = (F.col("a") == F.col("b")) & (F.size(F.split("a", " ")) <= 12)
    shared = shared.where((F.col("n") > 1) & ~refrain).select("doc_id", "gram")
    flagged = parts.join(shared, ["doc_id", "gram"], "left_semi").select("doc_id", "p", "s").distinct()
    return _hits(rows.join(flagged, ["doc_id", "p", "s"], "left_semi"), F.lit("Four words in a row stand elsewhere in the document too."))


@check("uniform_cadence")
def uniform_cadence(seg, params, blocks):
    """Runs of five or more sentences whose lengths stay within three words of the first one's.

    A run that is long enough is reported and the next begins after it; else the next begins at
    the sentence after its first. A fold over the sentences in order holds the run of each open
    beginning, of which there are at most four before one is long enough or falls away.
    """
    rows = _of(seg.sentences, blocks).where("block = 'paragraph'")
    n = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", "s", "start", "end", n.alias("n")))).alias("all")).where(F.size("all") >= 5)
    state = "struct<open:array<struct<n:int,start:int,len:int>>,run:struct<n:int,start:int,end:int>,done:array<struct<start:int,end:int>>>"
    start = F.from_json(F.lit('{"open":[],"run":null,"done":[]}'), state)
    done_type = "array<struct<start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        near = lambda r: F.abs(r["n"] - x["n"]) <= 3
        run = acc["run"]
        goes_on = run.isNotNull() & near(run)
        closed = F.when(run.isNotNull() & ~near(run), F.array_append(acc["done"], F.struct(run["start"].alias("start"), run["end"].alias("end")))).otherwise(acc["done"]).cast(done_type)
        grown = F.transform(F.filter(acc["open"], near), lambda r: F.struct(r["n"].alias("n"), r["start"].alias("start"), (r["len"] + 1).alias("len")))
        fresh = F.array_append(grown, F.struct(x["n"].cast("int").alias("n"), x["start"].alias("start"), F.lit(1).alias("len")))

        def settle(open_: Column) -> Column:
            # Beginnings are in order: the first that has five is a run, and the later ones end.
            long = F.get(F.filter(open_, lambda r: r["len"] >= 5), F.lit(0))
            now = F.when(goes_on, F.struct(run["n"].alias("n"), run["start"].alias("start"), x["end"].alias("end"))).when(
                long.isNotNull(), F.struct(long["n"].alias("n"), long["start"].alias("start"), x["end"].alias("end"))
            )
            left = F.when(now.isNotNull(), F.slice(open_, 1, 0)).otherwise(open_)
            return F.struct(left.alias("open"), now.alias("run"), closed.alias("done")).cast(state)

        return let(fresh, settle)

    finish = lambda acc: F.when(acc["run"].isNotNull(), F.array_append(acc["done"], F.struct(acc["run"]["start"].alias("start"), acc["run"]["end"].alias("end")))).otherwise(acc["done"]).cast(done_type)
    runs = exploded(per, F.aggregate("all", start, step, finish), "r")
    return _hits(runs, F.lit("Five sentences or more in a row have nearly the same length."), F.col("r.start"), F.col("r.end"))
