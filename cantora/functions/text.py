"""Text expressions: cleaning, script tests, counts, spoken numbers. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X

KHMER, THAI = r"ក-៿", r"฀-๿"


#: White space as (?U)\s has it.
_WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    # a search for white space would try every place of the text; this looks at its ends
    return F.btrim(c, F.lit(_WHITE))


def clean_text(c: Column) -> Column:
    """Line ends as LF, no blanks before them, at most one empty line in a row."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\r", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def script_share(c: Column, block: str) -> Column:
    """Characters of a block over characters that are not white space; null if there are none."""
    solid = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    return F.length(F.regexp_replace(c, f"[^{block}]", "")) / F.nullif(solid, F.lit(0))


def is_script(c: Column, block: str) -> Column:
    return F.coalesce(script_share(c, block) > 0.3, F.lit(False))


def route(c: Column, lang: Column | None = None) -> Column:
    """The language to read in: the one asked for, if it is known, else by script."""
    by_script = F.when(is_script(c, KHMER), "km").when(is_script(c, THAI), "th").otherwise("en")
    return by_script if lang is None else F.when(lang.isin("km", "th", "en"), lang).otherwise(by_script)


def speakable(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def speaker_label(c: Column) -> Column:
    """Whether a text is a label such as `A` or `B 2`: one to four letters, digits, blanks, `_` or `-`, none of them Khmer."""
    t = strip(F.coalesce(c, F.lit("")))
    return t.rlike(r"^[\p{L}\p{N} _-]{1,4}$") & ~t.rlike(f"[{KHMER}]")


def roll(style: Column, at: Column, text: Column) -> Column:
    """A repeatable chance between 0 and 0.99."""
    return (F.crc32(F.concat_ws("|", style, at.cast("string"), F.substring(text, 1, 12)).cast("binary")) % 100) / 100.0


def plain_path(c: Column) -> Column:
    """A pasted path: blanks and quotes around it go, the last drive letter starts it, slashes are all the same and single."""
    t = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "^\"+|\"+$|^'+|'+$", "")
    t = F.regexp_replace(strip(t), r"^.+(?=[A-Za-z]:[\\/])", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\\", "/"), r"/(\./)+", "/"), r"(?<=.)/+(?=/|$)", "")


def asked(job: Column, fmt: Column, lines: Column) -> Column:
    """Why a request is refused; null: it is not. lines: the texts to read."""
    empty = F.exists(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.coalesce(strip(x) == "", F.lit(True)))
    return F.coalesce(
        F.when(F.coalesce(F.size(lines) <= 0, F.lit(True)), "lines required"), F.when(empty, "each line needs a non-empty text string"),
        F.when(~F.coalesce(strip(job), F.lit("")).rlike(r"^[0-9a-zA-Z-]{16,64}$"), "job id required (16-64 chars)"), F.when(~F.lower(F.coalesce(F.nullif(fmt, F.lit("")), F.lit("mp3"))).isin("mp3", "wav"), "format must be mp3 or wav"),
    )


#: Most units and characters of one episode.
MOST_UNITS, MOST_CHARS = 40_000, 8_000_000


def within_limits(units: Column, chars: Column, strict: bool = False) -> Column:
    """Whether an episode is short enough; strict: an error if it is not."""
    ok = (units <= MOST_UNITS) & (chars <= MOST_CHARS)
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("the episode is too long")).cast("boolean")) if strict else ok


def replaced(c: Column, terms: dict[str, str]) -> tuple[Column, Column]:
    """(text, how many): each term's places replaced, the longest term first."""
    n = F.lit(0)
    for term in sorted(filter(None, terms), key=len, reverse=True):
        n = n + ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")
        c = F.replace(c, F.lit(term), F.lit(terms[term]))
    return c, n


def longest_first(terms: list[str]) -> str:
    """A pattern of the terms in which a longer one wins over its own beginning."""
    return "|".join(f"\\Q{t}\\E" for t in sorted(set(filter(None, terms)), key=lambda t: (-len(t), t)))


def looks_like_year(c: Column, at: Column) -> Column:
    """Whether a year marker stands in the 20 characters before a place (from 0)."""
    start = F.greatest(F.lit(0), at - 20)
    back = F.substring(c, start + 1, at - start)
    return F.exists(F.array(*map(F.lit, X.YEAR_MARKERS)), lambda m: back.contains(m))


def whole_number(c: Column) -> Column:
    """A written number without its groups and its fraction: 1,234.99 is 1234."""
    return F.regexp_replace(F.regexp_replace(c, ",", ""), r"\..*", "").cast("long")


def number_signs(c: Column) -> dict[str, Column]:
    """How many Khmer digits, percentages, sums of money and numbers a text has."""
    found = lambda p: F.regexp_count(c, F.lit(p))
    return {"khmer_digits": found("[០-៩]"), "percent": found(r"(?U)\d+(?:\.\d+)?\s*%"), "currency": found(r"(?iU)(\$|៛|\briel)\s*\d"), "numbers": found(r"(?U)\b\d+(?:\.\d+)?\b")}


def word_count(c: Column) -> Column:
    """Runs of white space + 1 from three runs on; else a quarter of the Khmer characters, at least 1."""
    runs = F.regexp_count(c, F.lit(r"(?U)\s+"))
    return F.when(runs >= 3, runs + 1).otherwise(F.greatest(F.lit(1), F.expr("0") + F.floor(F.length(F.regexp_replace(c, f"[^{KHMER}]", "")) / 4))).cast("int")


def topic(c: Column) -> Column:
    """First line, at most 70 characters, cut back to a whole word."""
    line = strip(F.substring_index(strip(c), "\n", 1))
    cut = F.regexp_extract(F.substring(line, 1, 70), r"(?s)^(.*) ", 1)
    return F.when(F.length(line) <= 70, line).otherwise(F.when(cut == "", F.substring(line, 1, 70)).otherwise(cut))


def manuscript(c: Column) -> Column:
    """What a narrator says of a marked-up line: marks, bullets, numbering, emphasis, links, tags and rules go; dashes become pauses, or `to` in a range."""
    steps = [
        (r"\A[ \t]*#{1,6}[ \t]*", ""), (r"\A[ \t]*>+[ \t]*", ""), (r"\A[ \t]*[-*+•‣▪●][ \t]+", ""), (r"\A[ \t]*\(?[0-9]{1,3}[.)។][ \t]+", ""),
        (r"\A[ \t]*[០-៩]{1,3}[.)។][ \t]+", ""), (r"\A[ \t]*[០-៩]{1,3}[ \t]+(?=[ក-អ])", ""), (r"\*\*|__|`|\*", ""), (r"[#|]", " "), (r"\\", ""), (r"~~(.+?)~~", "$1"),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]{1,60}>", " "), (r"\A\s*[-=_~]{3,}\s*\z", " "), (r"(?<=[0-9])\s*[‐‑‒–—―−]\s*(?=[0-9])", " to "), (r"[‐‑‒–—―−]", ","),
        (r"[ \t]+([,.;:!?។-៙])", "$1"), (r"[ \t]{2,}", " "),
    ]
    c = F.coalesce(c, F.lit(""))
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def unit_key(voice: Column, rate: Column, text: Column) -> Column:
    """Cache key of a spoken unit."""
    return F.substring(F.sha1(F.concat_ws("|", voice, rate, text)), 1, 24)


def khmer_digits(c: Column) -> Column:
    return F.translate(c, "០១២៣៤៥៦៧៨៩", "0123456789")


def _digit(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))


def _under_thousand(n: Column) -> Column:
    hundreds, rest = F.floor(n / 100), n % 100
    tens = F.when(rest >= 10, F.concat(_digit(X.TENS, F.floor(rest / 10)), F.when(rest % 10 > 0, _digit(X.ONES, rest % 10)).otherwise(""))).when(rest > 0, _digit(X.ONES, rest)).otherwise("")
    return F.concat(F.when(hundreds > 0, F.concat(_digit(X.ONES, hundreds), F.lit(X.HUNDRED))).otherwise(""), tens)


def _under_million(n: Column) -> Column:
    out = []
    for scale, word in ((100000, X.HUNDRED_THOUSAND), (10000, X.TEN_THOUSAND), (1000, X.THOUSAND)):
        q = F.floor(n / scale)
        out.append(F.when(q > 0, F.concat(_digit(X.ONES, q), F.lit(word))).otherwise(""))
        n = n % scale
    return F.concat(*out, _under_thousand(n))


def number_words(n: Column) -> Column:
    """A whole number of the long type as spoken Khmer; thousands of millions are millions of what stands before them."""
    a = F.abs(n.cast("long"))
    said = F.lit("")
    for k in (3, 2, 1):
        block = F.floor(a / F.lit(10 ** (6 * k)).cast("decimal(20,0)")).cast("long") % 1000000
        said = F.concat(said, F.when(block > 0, _under_million(block)).otherwise(""), F.when(F.floor(a / F.lit(10 ** (6 * k)).cast("decimal(20,0)")) > 0, X.MILLION).otherwise(""))
    said = F.when(a == 0, X.ONES[0]).otherwise(F.concat(said, _under_million(a % 1000000)))
    return F.when(n < 0, F.concat(F.lit(X.MINUS), said)).otherwise(said)


def ordinal_words(n: Column) -> Column:
    return F.concat(F.lit(X.ORDINAL), number_words(n))


def digit_words(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda d: d.rlike("^[0-9]$")), lambda d: _digit(X.ONES, d.cast("int"))), " ")


def decimal_words(whole: Column, part: Column) -> Column:
    return F.concat_ws(" ", number_words(whole), F.lit(X.POINT), number_words(part))


def rate_percent(rate: Column) -> Column:
    return F.format_string("%+d%%", F.bround((rate - 1.0) * 100, 0).cast("int"))


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))
