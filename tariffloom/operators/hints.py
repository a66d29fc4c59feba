"""Hints from the first lines of a document's text, and cleaning of recognised text, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import ANY_CASE, SPACE, let
from .once import told

#: Words of a provider's line, known cities, and the forms of the other hints.
PROVIDER_WORDS = (
    "клиник", "центр", "медицин", "тоо", "ао ", "оао", "больниц", "госпиталь", "лаборатор", "diagnost", "clinic", "hospital", "медлаб", "поликлиник", "стоматолог", "медицинский",
)
KNOWN_CITIES = (
    "алматы", "астана", "нур-султан", "нурсултан", "шымкент", "караганда", "актобе", "тараз", "павлодар", "усть-каменогорск", "семей", "атырау", "костанай", "кызылорда", "уральск",
    "петропавловск", "актау", "темиртау", "туркестан", "кокшетау", "талдыкорган", "экибастуз", "рудный", "жезказган",
)
BUSINESS_NUMBER = r"\b(?:БИН|ИИН|BIN)\s*[:№#]?\s*(\d{12})\b"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+7|\b8)[\s\-(]*\d{3}[\s\-)]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}\b"
CITY = r"\b(?:г\.?|город|қала)\s*([А-ЯЁA-Z][а-яёa-z\-]+)"
ADDRESS = r"((?:ул\.|улица|пр\.|проспект|мкр\.|микрорайон|көше|даңғыл)[^\n,;]{2,60}(?:[, ]+(?:д\.?|дом|№)?\s*\d+[А-Яа-яA-Za-z/]*)?)"
DATED = r"(?:прайс[\- ]?лист\s+(?:на|от)|прайс\s+(?:на|от)|действ\w*\s+с|от|на)\s+([0-3]?\d[.\-/][01]?\d[.\-/]\d{2,4}|\d{4}[.\-/][01]?\d[.\-/][0-3]?\d)"
BARE_DATE = r"\b([0-3]?\d[.\-/][01]?\d[.\-/]\d{4}|\d{4}-[01]\d-[0-3]\d)\b"
HEAD, PROVIDER_LINES, TITLE_LINES = 40, 25, 10


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """What the pattern first finds, in any letter case; null if nothing."""
    return F.nullif(F.regexp_extract(text, ANY_CASE + pattern, group), F.lit(""))


def filled_lines(text: Column) -> Column:
    """A text's lines without surrounding white space and without empty ones; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")


def first_line(lines: Column, keep) -> Column:
    return F.try_element_at(F.filter(lines, keep), F.lit(1))


def provider_line(lines: Column) -> Column:
    """The first line of the first PROVIDER_LINES with an organisation's word, else the first title-like one."""
    named = first_line(F.slice(lines, 1, PROVIDER_LINES), lambda x: (F.length(x) <= 120) & let(F.lower(x), lambda low: F.exists(F.array(*map(F.lit, PROVIDER_WORDS)), lambda w: F.contains(low, w))))
    title = first_line(F.slice(lines, 1, TITLE_LINES), lambda x: (F.length(x) <= 100) & x.rlike("\\p{L}"))
    return F.regexp_replace(F.coalesce(named, title), "^[ «»\"']+|[ «»\"']+$", "")


def written_date(text: Column) -> Column:
    """A date with the day first, or the year; then with the month first where the day comes out too large."""
    parts = let(F.split(text, "[.\\-/]"), lambda p: F.when(F.length(F.get(p, F.lit(0))) == 4, p).otherwise(F.reverse(p)))
    year = lambda p: F.get(p, F.lit(0)).cast("int")
    full = lambda p: F.when(year(p) < 100, year(p) + 2000).otherwise(year(p))
    made = lambda p, a, b: F.try_to_timestamp(F.concat_ws("-", full(p), F.get(p, F.lit(a)), F.get(p, F.lit(b))), F.lit("y-M-d")).cast("date")
    return F.when(text.isNotNull(), let(parts, lambda p: F.coalesce(made(p, 1, 2), made(p, 2, 1))))


def header_hints(text: Column) -> Column:
    """partner_name, bin, email, phone, city, address and effective_date of a document's text, each null if not found.

    Only the first HEAD filled lines are searched. A word after a city mark counts only if it is a known city; else the
    first known city in the order of the list that occurs anywhere there."""

    def read(lines: Column) -> Column:
        return let(F.array_join(F.slice(lines, 1, HEAD), "\n"), lambda head: told_of(lines, head))

    def told_of(lines: Column, head: Column) -> Column:
        any_city = let(F.lower(head), lambda low: first_line(F.array(*map(F.lit, KNOWN_CITIES)), lambda c: F.contains(low, c)))
        city = let(F.lower(found(head, CITY, 1)), lambda marked: F.when(marked.isin(*KNOWN_CITIES), marked).otherwise(any_city))
        titled = F.array_join(F.transform(F.split(city, "-"), lambda w: F.initcap(w)), "-")
        return F.struct(
            provider_line(lines).alias("partner_name"), found(head, BUSINESS_NUMBER, 1).alias("bin"), found(head, EMAIL).alias("email"), found(head, PHONE).alias("phone"),
            titled.alias("city"), F.regexp_replace(found(head, ADDRESS, 1), "^[ ,;]+|[ ,;]+$", "").alias("address"),
            F.coalesce(written_date(found(head, DATED, 1)), written_date(found(head, BARE_DATE, 1))).alias("effective_date"),
        )

    return let(filled_lines(text), read)


def with_header_hints(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with the hints as columns; a hint that a document already has stays."""
    hints = told(documents, documents.columns, _hints=header_hints(F.col(text)))
    names = ("partner_name", "bin", "email", "phone", "city", "address", "effective_date")
    return hints.withColumns({n: F.coalesce(n, f"_hints.{n}") if n in documents.columns else F.col(f"_hints.{n}") for n in names}).drop("_hints")


#: Letters that recognition shows for digits, besides those of price cells' own.
RECOGNISED = {
    "O": "0", "o": "0", "О": "0", "о": "0", "Q": "0", "l": "1", "I": "1", "|": "1", "¡": "1", "З": "3", "z": "2", "Z": "2", "S": "5", "s": "5", "B": "8", "б": "6", "g": "9",
}
SHARE = 0.6
#: What a text whose blanks are to be cleaned has somewhere.
UNCLEAN = "[\\r\\n\\t\\u00A0\\u202F]|  |^ | $"


def repaired_numbers(text: Column, letters: dict[str, str] = RECOGNISED) -> Column:
    """Tokens with a real digit that are digits and look-alikes to SHARE or more, but for points, get digits for these."""
    sources, digits = "".join(letters), "".join(letters.values())

    def alike(core: Column) -> Column:
        return F.length(F.regexp_replace(core, f"[^\\d{sources}]", "")) >= SHARE * F.length(core)

    def token(t: Column) -> Column:
        return F.when(t.rlike("\\d") & let(F.regexp_replace(t, "[.,]", ""), alike), F.translate(t, sources, digits)).otherwise(t)

    tokens = F.regexp_extract_all(text, F.lit("(?U)\\s+|\\S+"), F.lit(0))
    return F.when(text.rlike("(?U)\\s"), F.array_join(F.transform(tokens, token), "")).otherwise(token(text))


def cleaned_text(text: Column) -> Column:
    """Recognised text with numbers repaired, runs of blanks as one, trimmed lines and no more than one empty line in a row.

    Texts without blanks to clean keep theirs, and only those with a digit and a look-alike have numbers to repair."""

    def blanks(t: Column) -> Column:
        one = F.regexp_replace(F.regexp_replace(t, "\\r\\n?", "\n"), "[ \\t\\u00A0\\u202F]+", " ")
        lines = F.array_join(F.transform(F.split(one, "\n"), lambda x: F.trim(x)), "\n")
        return F.regexp_replace(F.regexp_replace(lines, "^\\n+|\\n+$", ""), "\\n{3,}", "\n\n")

    whole = F.coalesce(text, F.lit(""))
    mended = F.when(whole.rlike("\\d") & whole.rlike(f"[{''.join(RECOGNISED)}]"), repaired_numbers(whole)).otherwise(whole)
    return let(mended, lambda t: F.when(t.rlike(UNCLEAN), blanks(t)).otherwise(t))
