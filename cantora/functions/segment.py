"""Segmentation: sentences with their boundary, chunks, chapters, script lines, as array expressions to explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .greedy import groups, let
from .text import strip

LONGEST = 450


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x != "")


def _pieces(line: Column, stops: str) -> Column:
    got = F.filter(F.transform(F.regexp_extract_all(line, F.lit(f"[^{stops}]*[{stops}]*"), F.lit(0)), strip), lambda x: x != "")
    return let(got, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(line)))


def batch_sentences(c: Column) -> Column:
    """Sentences of each line without its list mark."""
    lines = F.transform(_lines(c), lambda x: F.regexp_replace(x, r"(?U)^\s*(?:-|\*|•)\s+", ""))
    return F.flatten(F.transform(lines, lambda x: _pieces(x, ".!?។เ")))


def studio_units(c: Column) -> Column:
    """plan_units that also stop at the Thai sign that ends words; a unit of signs alone joins the one before it and gives it its boundary, if it has one; without one before it goes."""
    state = F.array().cast("array<struct<text:string,boundary:string>>")

    def step(a, u):
        silent, last = ~u["text"].rlike(r"[\p{L}\p{N}]"), F.element_at(a, -1)
        glued = F.struct(strip(F.concat_ws(" ", F.regexp_replace(last["text"], r"(?U)\s+$", ""), u["text"])).alias("text"), F.when(u["boundary"] != "para", u["boundary"]).otherwise(last["boundary"]).alias("boundary"))
        return F.when(silent & (F.size(a) == 0), a).when(silent, F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), glued)).otherwise(F.array_append(a, u))

    # only texts that have a silent unit are folded
    return let(plan_units(c, ".!?…เ។"), lambda units: F.when(F.exists(units, lambda u: ~u["text"].rlike(r"[\p{L}\p{N}]")), F.aggregate(units, state, step)).otherwise(units))


def plan_units(c: Column, stops: str = ".!?…។") -> Column:
    """(text, boundary): sentences; boundary is the closing sign or `para`. One over 450 characters is cut at its last blank from 60 on."""

    def cut(piece: Column) -> Column:
        end = F.substring(piece, -1, 1)  # pieces are stripped
        last = F.when(end.isin(*stops), end).otherwise(F.lit("para"))
        start = F.struct(piece.alias("rest"), F.array().cast("array<struct<text:string,boundary:string>>").alias("out"))

        def step(a, _):
            at = F.length(F.regexp_extract(F.substring(a["rest"], 1, LONGEST), r"^(.*) ", 1))
            at = F.when(at < 60, LONGEST).otherwise(at)
            unit = F.struct(strip(F.substring(a["rest"], F.lit(1), at)).alias("text"), F.lit(".").alias("boundary"))
            more = F.struct(strip(F.substring(a["rest"], at + 1, F.length(a["rest"]))).alias("rest"), F.array_append(a["out"], unit).alias("out"))
            return F.when(F.length(a["rest"]) > LONGEST, more).otherwise(a)

        # each cut takes 60 characters at least
        folded = F.aggregate(F.sequence(F.lit(0), F.floor(F.length(piece) / 60).cast("int")), start, step, lambda a: F.when(a["rest"] == "", a["out"]).otherwise(F.array_append(a["out"], F.struct(a["rest"].alias("text"), last.alias("boundary")))))
        return F.when(F.length(piece) <= LONGEST, F.array(F.struct(piece.alias("text"), last.alias("boundary")))).otherwise(folded)

    return F.filter(F.flatten(F.transform(F.flatten(F.transform(_lines(c), lambda x: _pieces(x, stops))), cut)), lambda u: u["text"] != "")


def dialogue_sentences(c: Column) -> Column:
    got = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^.!?…]*[.!?…]+|[^.!?…]+$"), F.lit(0))
    return F.filter(F.transform(got, strip), lambda x: F.length(x) > 1)


def chunk_sentences(sentences: Column, most: int = 4, room: int = 280) -> Column:
    """Sentences joined greedily: at most `most` and `room` characters together; an overlong one is alone."""
    # each sentence brings a blank, the first one's is not there
    packed = lambda s: F.transform(groups(F.transform(s, lambda x: F.length(x) + 1), room + 1, most), lambda g: F.array_join(F.slice(s, g["start"] + 1, g["n"]), " "))
    return F.when(sentences.isNotNull(), let(sentences, packed))


def chapters(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, part, num, title, body: a text cut at its chapter headers; without any it is one chapter 1; what comes before the first is chapter 0."""
    header = r"(?i)^\s*(?:chapter|ch\.|ជំពូក)\s*([0-9០-៩]+)(.*)$"
    from .text import khmer_digits

    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r", "\n"), "\n")).alias("at", "line"))
    w = W.partitionBy("doc_id").orderBy("at")
    lines = lines.withColumn("head", F.col("line").rlike(header)).withColumn("part", F.sum(F.col("head").cast("int")).over(w))
    title = F.regexp_replace(F.regexp_extract("line", header, 2), r"^[: \s-]+", "")
    parts = lines.groupBy("doc_id", "part").agg(
        F.max(F.when(F.col("head"), khmer_digits(F.regexp_extract("line", header, 1)).cast("int"))).alias("num"),
        F.max(F.when(F.col("head"), strip(title))).alias("title"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("at", "line")))), lambda x: x["line"]), "\n")).alias("body"),
    )
    several = F.max("part").over(W.partitionBy("doc_id")) > 0
    num, name = F.coalesce("num", F.when(several, 0).otherwise(1)), F.coalesce("title", F.when(several, "preamble").otherwise(""))
    return parts.select("doc_id", "part", num.alias("num"), name.alias("title"), "body").filter("body != ''")


def script_lines(c: Column) -> Column:
    """(s, text): lines of a script with their speaker A or B; lines without one alternate by how many came before."""
    lines = _lines(c)
    named = r"(?i)^(?:HOST\s*)?\[?([AB])\]?\s*[:\-–]\s*(.*)$"
    return F.transform(lines, lambda x, i: F.struct(F.when(x.rlike(named), F.upper(F.regexp_extract(x, named, 1))).when(i % 2 == 0, "A").otherwise("B").alias("s"), F.when(x.rlike(named), F.regexp_extract(x, named, 2)).otherwise(x).alias("text")))
