"""Scalar expressions on names, gaps and texts. All are built-in functions but ``normalize_exact``."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that become "-", articles and titles dropped from the front of a name (first match wins), days of
# each unit of time, stems of number words.
DASHES = "‐‑‒–—―−"
ARTICLES = ["l'", "le ", "la ", "les "]
TITLES = ["m.", "mme", "mlle", "monsieur", "madame", "mademoiselle", "monseigneur", "mgr", "inspecteur", "commissaire", "docteur", "dr", "professeur", "maître", "évêque", "abbé", "capitaine", "colonel", "général", "lieutenant", "sergent", "comte", "comtesse", "baron", "baronne", "duc", "duchesse", "prince", "princesse", "sir", "lord", "lady"]
UNIT_DAYS = {"heure": 1 / 24, "nuit": 1.0, "jour": 1.0, "journée": 1.0, "semaine": 7.0, "mois": 30.0, "an": 365.0, "année": 365.0}
NUMBER_WORDS = {"vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60}

_WHITE = r"(?U)\s+"
_ARTICLE_RE = "^(?:" + "|".join(ARTICLES) + ")"
_TITLE_RE = "^(?:" + "|".join(t.replace(".", r"\.") for t in TITLES) + ") "


def normalize_name(name: Column) -> Column:
    """A name's key: dashes and apostrophes unified, white space collapsed, lower case with ß as ss.

    Compatibility forms (NFKC) have no built-in function: ``normalize_exact`` is the path for text that holds them.
    """
    unified = F.translate(name, DASHES + "’", "-" * len(DASHES) + "'")
    single = F.regexp_replace(unified, _WHITE, " ")
    return F.replace(F.lower(F.trim(single)), F.lit("ß"), F.lit("ss"))


def normalize_exact(name: Column | str) -> Column:
    """The same with NFKC and full case folding, in Arrow batches."""
    table = str.maketrans({**dict.fromkeys(DASHES, "-"), "’": "'"})

    def one(x):
        return " ".join(unicodedata.normalize("NFKC", x).translate(table).split()).casefold()

    def keys(names):
        return names.map(one, na_action="ignore")

    return F.pandas_udf(keys, "string")(name)


def strip_title(key: Column) -> Column:
    """A normalised name without one leading article and one leading title; null if nothing is left or changed."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(key, _ARTICLE_RE, ""), _TITLE_RE, ""))
    return F.when((bare != "") & (bare != key), bare)


def mention_keys(name: Column) -> Column:
    key = normalize_name(name)
    return F.array_compact(F.array(key, strip_title(key)))


def gap_to_days(value: Column, unit: Column) -> Column:
    """Days of a quantified gap; null if the value is not positive or the unit unknown. Plural s is accepted."""
    table = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])
    key = F.lower(F.trim(unit))
    days = F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.regexp_replace(key, "s+$", "")))
    return F.when(value > 0, value * days)


def parse_number(text: Column) -> Column:
    """The first run of digits, else the first number word that the text contains, else null."""
    digits = F.regexp_extract(text, r"(\d+)", 1)
    words = F.lit(None).cast("int")
    for word, n in reversed(NUMBER_WORDS.items()):
        words = F.when(F.contains(F.lower(text), F.lit(word.rstrip("e"))), n).otherwise(words)
    return F.when(digits != "", digits.try_cast("int")).otherwise(words)


def split_chunks(text: Column, max_chars: int = 8000) -> Column:
    """Chunks of whole paragraphs (parted by a blank line), packed in order; longer paragraphs are cut hard."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: F.trim(F.regexp_replace(p, _WHITE, " ")) != "")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"]))

    def step(acc: Column, p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / max_chars).cast("int")), lambda i: F.substring(p, i * max_chars + 1, F.lit(max_chars)))
        long = F.length(p) > max_chars
        full = F.length(acc["cur"]) + 2 + F.length(p) > max_chars
        out = F.when(long, F.concat(flushed(acc), cut)).when(full, flushed(acc)).otherwise(acc["out"])
        cur = F.when(long, F.lit(None)).when(acc["cur"].isNull() | full, p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        return F.struct(out.alias("out"), cur.cast("string").alias("cur"))

    return F.aggregate(paragraphs, zero, step, flushed)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def links(n: Column) -> Column:
    """Links within a cluster of n; one for a single member, by convention."""
    return F.when(n == 1, F.lit(1.0)).otherwise(n * (n - 1) / 2.0)


def escape_json_for_html(json: Column) -> Column:
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def key_of(name: str | None) -> str:
    """``normalize_exact`` of one value."""
    table = str.maketrans({**dict.fromkeys(DASHES, "-"), "’": "'"})
    return " ".join(unicodedata.normalize("NFKC", name or "").translate(table).split()).casefold()


def bare_of(key: str) -> str | None:
    """``strip_title`` of one value."""
    bare = re.sub(_TITLE_RE, "", re.sub(_ARTICLE_RE, "", key)).strip()
    return bare if bare and bare != key else None


def days_of(value: float | None, unit: str | None) -> float | None:
    """``gap_to_days`` of one value."""
    name = (unit or "").strip().lower()
    per = UNIT_DAYS.get(name, UNIT_DAYS.get(name.rstrip("s")))
    return value * per if per and value and value > 0 else None


def chunks_of(text: str | None, most: int = 8000) -> list[str]:
    """``split_chunks`` of one text: paragraphs packed greedily, over-long ones cut."""
    if most <= 0:
        raise ValueError("chunks need a positive size")
    out: list[str] = []
    room = 0
    for paragraph in (p for p in (text or "").split("\n\n") if p.strip()):
        if len(paragraph) > most:
            out.extend(paragraph[i : i + most] for i in range(0, len(paragraph), most))
            room = 0
        elif out and len(paragraph) + 2 <= room:
            out[-1] += "\n\n" + paragraph
            room -= len(paragraph) + 2
        else:
            out.append(paragraph)
            room = most - len(paragraph)
    return out
