"""Text expressions. White space is Unicode's unless a name says otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.config import STOP_WORDS

LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a lambda that holds an expression computes it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: What Unicode counts as white space.
WHITE = "\t\n\u000b\u000c\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def strip_text(text: Column) -> Column:
    """Without white space at the ends, then without byte order marks at the start."""
    return F.regexp_replace(strip(text), "^﻿+", "")


def optional_text(text: Column) -> Column:
    """strip_text, or null if nothing is left."""
    return F.nullif(strip_text(text), F.lit(""))


def required_text(text: Column, name: str = "value") -> Column:
    """strip_text; fails the query if nothing is left."""
    cleaned = optional_text(text)
    return F.when(cleaned.isNotNull(), cleaned).otherwise(F.raise_error(F.lit(f"{name} must not be empty")).cast("string"))


def string_list(values: Column) -> Column:
    """Each element cleaned, empty ones dropped; null gives an empty list."""
    cleaned = F.filter(F.transform(values, strip_text), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """The lines of a text, whatever the line break; a break at the end makes no further line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def prose(text: Column) -> Column:
    """Lines stripped, runs of spaces and tabs made one space, empty lines dropped."""
    # White space with a line break in it is what lies between two lines that are not empty.
    joined = F.regexp_replace(text, r"(?U)[\s&&[^\r\n]]*+[\r\n]\s*+", "\n")
    return strip(F.regexp_replace(joined, "[ \t]{2,}|\t", " "))


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is in a text, byte order marks at its start aside; it looks no further than the first other character."""
    return text.rlike("(?U)^\ufeff*\\s*$")


def multiline(text: Column, strip_lines: bool) -> Column:
    """Each line stripped, or only at its end; empty lines stay within the text."""
    each = F.transform(F.split(line_endings(text), "\n", -1), strip if strip_lines else rstrip)
    return strip(F.array_join(each, "\n"))


def block_text(text: Column, block_type: Column) -> Column:
    """A block's text normalised by its type: code and JSON keep indents, tables keep lines, the rest is prose."""
    marked = F.ltrim(text, F.lit("\ufeff"))
    start = strip(line_endings(marked))
    return F.when(block_type.isin("code", "json"), multiline(start, False)).when(block_type == "table", multiline(start, True)).otherwise(prose(marked))


def parent_path(path: Column) -> Column:
    return F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), prose), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1)


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def windows_of(words: Column, target: int, overlap: int = 0) -> Column:
    """Windows of `target` of the words that overlap by `overlap`, joined by spaces; the last one ends the words."""
    if target < 1 or overlap < 0:
        raise ValueError("target must be at least 1 and overlap not negative")
    step = max(1, target - min(overlap, target - 1))

    def windows(own: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(own) - target) / F.lit(step))).cast("int")
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(own, i * step + 1, target), " "))
        return F.when(F.size(own) == 0, F.array().cast("array<string>")).otherwise(found)

    return bound(words, windows)


def singular(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when((n > 3) & token.endswith("ies"), F.concat(F.substr(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & token.endswith("s"), F.substr(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def fold_case(text: Column) -> Column:
    """Lower case, with sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def meaningful_tokens(text: Column) -> Column:
    """ASCII words in lower case without stop words, each in the singular; repeats stay."""
    words = F.regexp_extract_all(fold_case(text), F.lit("([a-z0-9]+)"), 1)
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.transform(kept, singular)


def singulars_of(token: str) -> list[str]:
    """The words whose singular is `token`, stop words left out."""
    tries = {token, f"{token}s", f"{token[:-1]}ies" if token.endswith("y") else token}
    single = lambda w: f"{w[:-3]}y" if len(w) > 3 and w.endswith("ies") else w[:-1] if len(w) > 3 and w.endswith("s") else w
    return sorted(w for w in tries if single(w) == token and w not in STOP_WORDS)


def meaningful_words(text: str) -> list[str]:
    """meaningful_tokens of a text on the driver, such as a query."""
    words = [w for w in re.findall("[a-z0-9]+", text.lower().replace("ß", "ss")) if w not in STOP_WORDS]
    return [f"{w[:-3]}y" if len(w) > 3 and w.endswith("ies") else w[:-1] if len(w) > 3 and w.endswith("s") else w for w in words]


def nfkc(text: Column) -> Column:
    """Case-folded NFKC form, which no built-in function gives."""

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield series.str.casefold().str.normalize("NFKC")

    return folded(text)


#: Texts with no other characters have their lower-case form, with ss for sharp s, as their case-folded NFKC form.
PLAIN = r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]"


def match_form(text: Column, plain_only: bool = False) -> Column:
    """The form in which terms are compared: words in the singular, joined by spaces.

    Only a text beyond ASCII and Latin-1 letters needs NFKC and so the slow path; `plain_only` leaves it out of the plan.
    """
    plain = fold_case(text)
    if not plain_only:
        beyond = F.when(text.rlike(PLAIN), text)
        plain = F.when(text.rlike(PLAIN), nfkc(beyond)).otherwise(plain)
    words = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    # `singular` of each word, in two passes over the whole: -ies first, which then ends in y; then -s of words of four letters or more.
    return F.regexp_replace(F.regexp_replace(words, r"(?<=[a-z0-9])ies(?= |$)", "y"), r"(?<=[a-z0-9]{3})s(?= |$)", "")


def term_matches(text_form: Column, text_words: Column, term_form: Column) -> Column:
    """Whether a normalised term occurs: as a substring, or all its two or more words anywhere."""
    words = F.split(term_form, " ")
    return text_form.contains(term_form) | ((F.size(words) > 1) & (F.size(F.array_except(words, text_words)) == 0))


def missing_terms(form: Column, terms: Column) -> Column:
    """The terms that do not match a text's match_form, in order. Terms are compared in their plain form."""
    forms = F.transform(terms, lambda t: F.struct(t.alias("term"), match_form(t, True).alias("form")))

    def missing(text: Column) -> Column:
        return F.transform(F.filter(forms, lambda t: ~term_matches(text["form"], text["words"], t["form"])), lambda t: t["term"])

    return bound(bound(form, lambda f: F.struct(f.alias("form"), F.split(f, " ").alias("words"))), missing)


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def excerpt(text: Column, limit: int = 520) -> Column:
    short = collapse(text)
    return F.when(F.length(short) <= limit, short).otherwise(F.concat(rstrip(F.substring(short, 1, limit - 3)), F.lit("...")))


def preview(text: Column, limit: int = 500) -> Column:
    """The first `limit` characters, with dots if there are more."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def session_title(text: Column, limit: int = 160) -> Column:
    return F.nullif(F.substring(collapse(text), 1, limit), F.lit(""))


def redacted_url(url: Column) -> Column:
    """A URL with what stands before its host's @ hidden."""
    hidden = F.concat(F.substring_index(F.substring_index(url, "@", 1), "://", 1), F.lit("://***@"), F.regexp_extract(url, "(?s)@(.*)$", 1))
    return F.when(url.contains("@"), hidden).otherwise(url)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("")), F.lit("Untitled Document"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def upload_name(name: Column) -> Column:
    """A file name with safe characters alone."""
    safe = F.regexp_replace(F.replace(strip(base_name(F.replace(name, F.lit("\\"), F.lit("/")))), F.lit(" "), F.lit("_")), "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("upload"))


def linked_citations(text: Column) -> Column:
    """Markers [n] (not before a parenthesis) and 【n…】 outside code spans as links to #source-n."""
    parts = F.regexp_extract_all(text, F.lit("(?s)(`+.*?`+|[^`]+|`)"), 1)

    def link(part: Column) -> Column:
        bracket = F.regexp_replace(part, r"\[(\d+)\](?!\()", r"[$1](#source-$1)")
        return F.when(part.startswith("`"), part).otherwise(F.regexp_replace(bracket, "【(\\d+)[^】]*】", r"[$1](#source-$1)"))

    return F.array_join(F.transform(parts, link), "")


def sse_event(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sse_parse(stream: Column) -> Column:
    """Events of a server-sent stream: an array of (event, data)."""
    blocks = F.filter(F.split(line_endings(stream), "\n\n"), lambda b: strip(b) != "")

    def parsed(block: Column) -> Column:
        rows = F.split(block, "\n")
        data = F.transform(F.filter(rows, lambda r: r.startswith("data:")), lambda r: F.regexp_replace(r, "^data: ?", ""))
        name = F.regexp_replace(F.element_at(F.filter(F.concat(F.filter(rows, lambda r: r.startswith("event:")), F.array(F.lit("event: message"))), lambda r: r.isNotNull()), 1), "^event: ?", "")
        return F.struct(name.alias("event"), F.array_join(data, "\n").alias("data"))

    return F.transform(blocks, parsed)


def duration_text(ms: Column) -> Column:
    """Milliseconds as 12ms, 1.2s or 2m 5s."""
    whole = F.floor(F.round(ms / 1000)).cast("long")
    return (
        F.when(ms < 1000, F.format_string("%dms", F.round(ms).cast("long")))
        .when(ms < 60000, F.format_string("%.1fs", (ms / 1000).cast("double")))
        .otherwise(F.format_string("%dm %ds", F.floor(whole / 60).cast("long"), whole % 60))
    )


def progress_line(stage: Column, status: Column, message: Column, ms: Column) -> Column:
    timed = F.when(ms.isNotNull(), F.concat(F.lit(" in "), F.format_string("%.1fs", (ms / 1000).cast("double")))).otherwise(F.lit(""))
    return F.concat(F.lit("["), F.upper(stage), F.lit(" "), F.upper(status), F.lit("] "), message, timed)


def percent_text(share: Column) -> Column:
    """A share as per cent with at most one digit after the point: 0.5 is 50%, 0.1234 is 12.3%."""
    value = F.round(share * 100, 1)
    return F.concat(F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("decimal(20,1)").cast("string")), F.lit("%"))


def compact_number(value: Column) -> Column:
    """A count as 950, 1.2K, 3.4M or 5B."""
    out = value.cast("long").cast("string")
    for size, sign in ((1_000, "K"), (1_000_000, "M"), (1_000_000_000, "B")):
        out = F.when(F.abs(value) >= size, F.concat(F.regexp_replace(F.round(value / size, 1).cast("decimal(20,1)").cast("string"), r"\.0$", ""), F.lit(sign))).otherwise(out)
    return out


def compact_fields(values: Column) -> Column:
    """A map of strings as k=v, k=v by key; null values are left out."""
    rows = F.array_sort(F.map_entries(F.map_filter(values, lambda k, v: v.isNotNull())))
    return F.array_join(F.transform(rows, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def clean_metadata(values: Column) -> Column:
    """A map of strings with stripped keys and values; blank keys and null or blank values are left out."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value")))
    sound = F.filter(entries, lambda e: (e["key"] != "") & e["value"].isNotNull() & (e["value"] != ""))
    # Of keys that are equal once stripped, the first one counts.
    return F.map_from_entries(F.filter(sound, lambda e, i: F.array_position(F.transform(sound, lambda x: x["key"]), e["key"]) == i + 1))


def iso_time(value: Column) -> Column:
    """A time as ISO text, with microseconds where there are any."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(value), F.lit(1_000_000))
    return F.when(micros == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))


def json_safe(value: Column, kind: T.DataType) -> Column:
    """A value of a Spark type with what JSON lacks as text, however deep: days and times in ISO form, decimals as they read. Keys are stripped, blank ones go, and of equal ones the last counts."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return iso_time(value.cast("timestamp"))
    if isinstance(kind, T.DateType | T.DecimalType):
        return value.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [json_safe(value[f.name], f.dataType).alias(f.name.strip()) for f in kind.fields if f.name.strip()]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(strip(e["key"].cast("string")).alias("key"), json_safe(e["value"], kind.valueType).alias("value")))
        keys = F.transform(entries, lambda e: e["key"])
        return F.map_from_entries(F.filter(entries, lambda e, i: (e["key"] != "") & ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])))
    return value


def metadata_variant(value: Column, kind: T.DataType) -> Column:
    """A map or struct of metadata as a VARIANT; null gives an empty one."""
    return F.coalesce(F.to_variant_object(json_safe(value, kind)), F.parse_json(F.lit("{}")))
