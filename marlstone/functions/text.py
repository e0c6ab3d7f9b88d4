"""Scalar functions over text columns: Column in, Column out, all on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number and size patterns, units in fluid ounces, speech limits.
NUMBER = r"[-+]?\d[\d,]*\.?\d*"
SIZE = r"(?i)(\d+(?:\.\d+)?)\s*(fl\.?\s*oz|fluid ounce|ounce|oz|ml|milliliter|l\b|liter|lb|pound|g\b|gram)"
OUNCES = {"oz": 1.0, "fl oz": 1.0, "fl. oz": 1.0, "fluid ounce": 1.0, "ounce": 1.0, "ml": 0.033814, "milliliter": 0.033814, "g": 0.033814, "gram": 0.033814, "l": 33.814, "liter": 33.814, "lb": 16.0, "pound": 16.0}
MATERIALS = ["stainless steel", "glass", "wood", "tile", "grout", "fabric", "porcelain", "ceramic", "chrome", "multi-surface"]
WORDS_PER_MINUTE, SPEECH_SECONDS = 150, 15.0
ABSENT = ["", "nan", "none"]
SPOKEN_NUMBERS = {"five": 5, "ten": 10, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30}
# Equivalent spoken forms, replaced in this order.
SPOKEN_FORMS = [
    ("$12.99", "twelve ninety nine"), ("12.99", "twelve ninety nine"), ("$15", "fifteen dollars"), ("15 dollars", "fifteen dollars"),
    ("$25", "twenty five dollars"), ("25 dollars", "twenty five dollars"), ("$40", "forty dollars"), ("40 dollars", "forty dollars"),
    ("$80", "eighty dollars"), ("80 dollars", "eighty dollars"), ("32 oz", "32 ounce"), ("32oz", "32 ounce"), ("32-ounce", "32 ounce"),
    ("32 ounce", "32 ounce"), ("4.5", "four point five"), ("4.5 stars", "four point five stars"),
]
WORD_START = r"(^|[^\p{L}\p{N}_])"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def present(raw: Column) -> Column:
    """Trimmed text; null for blanks and for the words that stand for a missing value."""
    text = F.trim(raw)
    return F.when(~F.lower(text).isin(*ABSENT), text)


def first_number(text: Column) -> Column:
    found = F.regexp_extract(text, NUMBER, 0)
    return F.when(found != "", found).try_cast("double")


def parse_price(raw: Column) -> Column:
    value = first_number(F.replace(present(raw), F.lit(","), F.lit("")))
    return F.when(value > 0, value)


def parse_rating(raw: Column) -> Column:
    """Thousands separators stay, so that a count such as 1,000 is no rating."""
    value = first_number(present(raw))
    return F.when((value > 0) & (value <= 5), value)


def parse_size_oz(*texts: Column) -> Column:
    """Of the first text whose first size has a known unit."""
    units = F.create_map(*[F.lit(x) for pair in OUNCES.items() for x in pair])

    def one(text: Column) -> Column:
        unit = F.replace(F.lower(F.regexp_extract(text, SIZE, 2)), F.lit("."), F.lit(""))
        return F.round(F.regexp_extract(text, SIZE, 1).try_cast("double") * F.try_element_at(units, unit), 3)

    return F.coalesce(*map(one, texts))


def price_per_oz(price: Column, size: Column) -> Column:
    return F.when((size > 0) & (price != 0), F.round(price / size, 4))


def split_features(text: Column, delimiter: str = r"\|", boilerplate: str = "make sure this fits") -> Column:
    parts = F.transform(F.split(text, delimiter), lambda x: F.trim(x, F.lit(" •-\t")))
    return F.filter(parts, lambda x: (x != "") & ~F.startswith(F.lower(x), F.lit(boilerplate)))


def clean_ingredients(raw: Column) -> Column:
    return F.coalesce(present(raw), F.lit(""))


def first_term(text: Column, terms: list[str]) -> Column:
    """The first of an ordered list of terms that the text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms])


def material_tag(title: Column, category: Column, materials: list[str] = MATERIALS) -> Column:
    return first_term(F.lower(F.concat_ws(" ", title, category)), materials)


def embed_text(title: Column, brand: Column, features: Column, ingredients: Column, snippets: Column) -> Column:
    def part(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value))

    return F.concat_ws("\n", F.when(title != "", title), part("Brand: ", brand), part("Features: ", F.array_join(features, "; ")), part("Ingredients: ", ingredients), part("Reviews: ", F.array_join(F.slice(snippets, 1, 3), " ")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading www; '' where there is none."""
    place = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":\d*$", ""), r"^www\.", "")


def result_key(url: Column, title: Column) -> Column:
    """What makes two search results the same: place and path of the URL, or else the title."""
    key = F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1), F.lit("/"))
    return F.coalesce(F.when(key != "", key), title)


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def speech_seconds(text: Column, wpm: int = WORDS_PER_MINUTE) -> Column:
    return F.size(word_list(text)) / F.lit(float(wpm)) * 60.0 if wpm > 0 else F.lit(0.0)


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x != "")


def truncate_to_budget(text: Column, seconds: float = SPEECH_SECONDS, wpm: int = WORDS_PER_MINUTE) -> Column:
    """The longest run of leading sentences that can be said in time, or the first words of the first."""
    most = max(1, int(seconds / 60 * wpm))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"), F.lit(True).alias("on"))

    def step(a: Column, s: Column) -> Column:
        n = a["n"] + F.size(word_list(s))
        fits = a["on"] & (n / F.lit(float(wpm)) * 60.0 <= seconds)
        return F.struct(F.when(fits, n).otherwise(a["n"]).alias("n"), F.when(fits, F.concat_ws(" ", F.when(a["out"] != "", a["out"]), s)).otherwise(a["out"]).alias("out"), fits.alias("on"))

    kept = F.aggregate(sentences(text), start, step, lambda a: a["out"])
    return F.when(kept != "", kept).otherwise(F.array_join(F.slice(word_list(F.get(sentences(text), F.lit(0))), 1, most), " "))


def content_id(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def cache_key(query: Column) -> Column:
    return F.lower(F.trim(query))


def starts_any_word(text: Column, terms: list[str]) -> Column:
    """Whether any of the terms begins a word of the text."""
    quoted = "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in t.lower()) for t in terms)
    return F.regexp_like(F.lower(text), F.lit(f"{WORD_START}({quoted})"))


def phrase_price(text: Column) -> Column:
    """A spoken upper price: words after under, below or less than come before digits, and those before a bare $."""
    low = F.lower(text)
    words = F.coalesce(*[F.when(F.regexp_like(low, F.lit(rf"(under|below|less than)\s+{w}")), F.lit(float(v))) for w, v in reversed(SPOKEN_NUMBERS.items())])
    digits = lambda p: F.regexp_extract(low, p, 1).try_cast("double")
    return F.coalesce(words, digits(r"(?:under|below|less than|<)\s*\$?\s*(\d+(?:\.\d+)?)"), digits(r"\$\s*(\d+(?:\.\d+)?)"))


def spoken_normal(text: Column) -> Column:
    """A transcript's words in one form, for comparison with another."""
    out = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    for old, new in SPOKEN_FORMS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(F.regexp_replace(out, "[-–—]", " "), "[’']", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def audio_name(path: Column) -> tuple[Column, Column]:
    """Query and speaker of a clip's file name, such as query03_deep.wav."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    speaker = F.regexp_extract(stem, "^[^_]*_(.+)$", 1)
    return F.split_part(stem, F.lit("_"), F.lit(1)), F.when(speaker.isin("", "original"), F.lit("original")).otherwise(speaker)


def missing_keys(raw: Column, required: list[str]) -> Column:
    """Required keys that a JSON object lacks; all of them if it is none. Sorted, comma-joined."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys)), ",")


def parsed_object(raw: Column, required: list[str]) -> Column:
    """struct(parsed, error): a JSON object with all required keys, or what is wrong with it."""
    value = F.try_parse_json(raw)
    missing = missing_keys(raw, required)
    error = (
        F.when(value.isNull(), F.lit("not valid JSON")).when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit("JSON is not an object"))
        .when(missing != "", F.concat(F.lit("missing required keys: "), missing))
    )
    return F.struct(F.when(error.isNull(), value).alias("parsed"), error.alias("error"))


def money(value: Column) -> Column:
    return F.format_string("$%.2f", value)


def shortest(value: Column) -> Column:
    """A number with up to six significant digits and no trailing zeros, as C's %g writes values of usual size."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-4)))).cast("int"))
    text = F.format_string("%.6f", F.round(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
