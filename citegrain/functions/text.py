"""Column builders for the engine's text rules. All stay in the JVM.

Five normal forms exist side by side and must not be merged: ``canonical_ws``
(identity of a passage), ``symptom_key``, ``title_key``, ``plain_key`` (section
headings) and ``furniture_key``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------
#: A term: alphanumeric runs joined by separators.
TERM = r"[a-z0-9]+(?:[-/._]+[a-z0-9]+)*"
SEPARATORS = r"[-/._]+"
#: Marker of a citation in an answer.
MARKER = r"\[\[p:([^\]\s]+)\]\]"
#: A number with a unit, in prose.
NUMERIC = r"(?<![\w.])[-+]?\d+(?:[.,]\d+)?(?:\s*(?:%|[A-Za-z]{1,4}\b))?"
#: A manual's file name; its parts in order: vendor, product, document type, version, language.
KEBAB = r"[a-z0-9]+(?:-[a-z0-9]+)*"
FILENAME = rf"\A({KEBAB})_({KEBAB})_({KEBAB})_v([0-9]+(?:\.[0-9]+)*)_([a-z]{{2}}|multi)\.pdf\z"
FILENAME_PARTS = ("vendor", "product", "doctype", "doc_version", "lang")
#: A pointer to a section: source, then a number after the section sign, then a quoted title.
POINTER = r'^\s*(\S+?)(?:\s*§\s*([^\s"“”]+))?(?:\s*["“]([^"”]*)["”])?\s*$'
#: A printed heading with its number, and a contents line: number, title, page.
SECTION = r"^\(?(\d+(?:\.\d+)*)\)?[.\s]\s*(\S.*)$"
CONTENTS = r"^\(?(\d+(?:\.\d+)*)?\)?\s*(\S.*?)[\s.]{3,}(\d+)$"
#: A cell that is a number.
WHOLE_NUMBER = r"[-+(]?\d+(?:[.,]\d+)*\)?"
# ------------------------------------------------------------------------


def folded(c: Column) -> Column:
    """Lower case with the German sharp s written out; ligatures and the dotted I aren't expanded."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def terms(c: Column) -> Column:
    """array<string>: each compound whole, then its parts; null text: no terms.

    Runs of separators inside a compound count as the first of them.
    """
    found = F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))
    whole = lambda t: F.regexp_replace(t, r"([-/._])[-/._]*", "$1")
    parts = lambda t: F.split(t, SEPARATORS)
    each = F.transform(found, lambda t: F.when(t.rlike(SEPARATORS), F.concat(F.array(whole(t)), parts(t))).otherwise(F.array(t)))
    return F.flatten(each)


def collapse(c: Column) -> Column:
    """White-space runs, the wider Unicode ones too, as one space; none at either end."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def canonical_ws(c: Column) -> Column:
    """The white-space half of a passage's identity; see ``functions.words.canonical`` for the normal form C."""
    return collapse(c)


def digest_id(source_id: Column, canonical: Column) -> Column:
    """`source_id#` and 16 hex digits of the canonical text's SHA-256."""
    return F.concat(source_id, F.lit("#"), F.substring(F.sha2(canonical, 256), 1, 16))


def symptom_key(c: Column) -> Column:
    return folded(collapse(c))


def entry_key(symptom: Column, devices: Column) -> Column:
    """SHA-256 of the symptom's key and the sorted distinct device ids, one a line."""
    return F.sha2(F.concat_ws("\n", symptom_key(symptom), F.array_sort(F.array_distinct(devices))), 256)


def title_key(c: Column) -> Column:
    """A section title without its number and trailing marks, folded."""
    bare = F.regexp_replace(F.trim(c), r"^\d+(?:\.\d+)*\.?\s+", "")
    return folded(F.regexp_replace(collapse(bare), r"(?U)[\s.,:;!?…]+$", ""))


def plain_key(c: Column) -> Column:
    return folded(collapse(c))


def furniture_key(c: Column) -> Column:
    """Two running heads are one if they differ in numbers alone."""
    return F.regexp_replace(folded(collapse(c)), r"[0-9]+", "#")


def font_family(c: Column) -> Column:
    """A font's name without its subset tag, folded to a-z and digits."""
    return F.regexp_replace(folded(F.regexp_replace(c, r"^[A-Z]{6}\+", "")), r"[^a-z0-9]", "")


def revision_alnum(c: Column) -> Column:
    """The comparison form of revisions in entries."""
    return F.regexp_replace(folded(c), r"(?U)[^\p{Alnum}]", "")


def revision_trimmed(c: Column) -> Column:
    """The comparison form of revisions in gap reports; null as empty."""
    return folded(F.trim(F.coalesce(c, F.lit(""))))


def slug(source_id: Column) -> Column:
    return F.replace(source_id, F.lit("/"), F.lit("_"))


def filename_identity(name: Column) -> Column:
    """Struct of the parts of a manual's file name; null where the name doesn't follow the grammar."""
    parts = F.struct(*[F.regexp_extract(name, FILENAME, i + 1).alias(p) for i, p in enumerate(FILENAME_PARTS)])
    return F.when(name.rlike(FILENAME), parts)


def identity_source_id(i: Column) -> Column:
    return F.concat(i["vendor"], F.lit("/"), i["product"])


def identity_display_name(i: Column) -> Column:
    """Vendor and product in title case; a letter after a digit is a capital too."""
    words = F.split(F.replace(F.concat_ws(" ", i["vendor"], i["product"]), F.lit("-"), F.lit(" ")), " ")
    titled = F.transform(words, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(r"[a-z]+|[^a-z]+"), F.lit(0)), F.initcap), ""))
    return F.array_join(titled, " ")


def identity_filename(i: Column) -> Column:
    return F.concat(i["vendor"], F.lit("_"), i["product"], F.lit("_"), i["doctype"], F.lit("_v"), i["doc_version"], F.lit("_"), i["lang"], F.lit(".pdf"))


def placeholder_filename(device: Column) -> Column:
    """The manual that a resolved device lacks; null unless the device is `vendor/product`."""
    vendor, product = F.substring_index(device, "/", 1), F.substring(device, F.locate("/", device) + 1, F.length(device))
    return F.when(device.contains("/"), F.concat(vendor, F.lit("_"), product, F.lit("_<doctype>_v<version>_<lang>.pdf")))


def pointer(c: Column) -> Column:
    """Struct (source_id, number, title) of a fix's pointer; null where it addresses nothing."""
    number = F.nullif(F.regexp_extract(c, POINTER, 2), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(c, POINTER, 3)), F.lit(""))
    return F.when(c.rlike(POINTER) & (number.isNotNull() | title.isNotNull()), F.struct(F.regexp_extract(c, POINTER, 1).alias("source_id"), number.alias("number"), title.alias("title")))


def pointer_key(p: Column) -> Column:
    """The number addresses a section where there is one, else the title's key."""
    return F.when(p["number"].isNotNull(), F.concat(p["source_id"], F.lit(" §"), p["number"])).otherwise(F.concat(p["source_id"], F.lit(' "'), title_key(p["title"]), F.lit('"')))


def section_number(c: Column) -> Column:
    """Struct (number, title) of a printed heading such as `24.1 Title` or `(1.3.1) Title`."""
    numbered = F.trim(c).rlike(SECTION)
    return F.struct(
        F.when(numbered, F.regexp_extract(F.trim(c), SECTION, 1)).alias("number"),
        F.when(numbered, F.trim(F.regexp_extract(F.trim(c), SECTION, 2))).otherwise(F.trim(c)).alias("title"),
    )


def contents_line(c: Column) -> Column:
    """Struct (number, title, page) of a contents line with dot leaders; null for other lines."""
    line = F.trim(c)
    part = lambda i: F.regexp_extract(line, CONTENTS, i)
    return F.when(line.rlike(CONTENTS), F.struct(F.nullif(part(1), F.lit("")).alias("number"), F.trim(part(2)).alias("title"), part(3).cast("int").alias("page")))


def is_numeric_cell(c: Column) -> Column:
    return F.trim(c).rlike(rf"\A{WHOLE_NUMBER}\z")


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def is_short(c: Column) -> Column:
    return word_count(c) <= 6


def is_suspect_char(c: Column) -> Column:
    """A letter outside ASCII: in a symbol font, probably a glyph with no text of its own."""
    return c.rlike(r"[\p{L}&&[^\x00-\x7F]]")


def markers(c: Column) -> Column:
    """array<string>: passages that a text cites, in order, repeats included."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MARKER), F.lit(1))


def without_markers(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, MARKER, ""), r"(?U)\s{2,}", " "))


def clean_delta(c: Column, known: Column) -> Column:
    """A piece of a stream without the markers outside ``known``; white space stays as it came, as pieces are put together again.

    The text is cut at its markers, and each piece is put back with its marker
    or without.
    """
    pieces = F.split(c, MARKER, -1)
    kept = F.transform(markers(c), lambda m: F.when(F.array_contains(known, m), F.concat(F.lit("[[p:"), m, F.lit("]]"))).otherwise(F.lit("")))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(kept, i), F.lit("")))), "")


def keep_known_markers(c: Column, known: Column) -> Column:
    """Struct (text, stripped): markers outside ``known`` go, with the white space they leave."""
    gone = F.size(F.filter(markers(c), lambda m: ~F.array_contains(known, m)))
    return F.struct(F.trim(F.regexp_replace(clean_delta(c, known), r"(?U)\s{2,}", " ")).alias("text"), gone.alias("stripped"))


def numeric_literals(c: Column) -> Column:
    """array<string>: numbers with their units, white space inside as one space."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMERIC), F.lit(0)), lambda x: F.regexp_replace(F.trim(x), r"(?U)\s+", " "))


def first_sentence(c: Column) -> Column:
    """Up to the first full stop, exclamation or question mark before white space; null for blank text."""
    flat = collapse(c)
    return F.when(flat != "", F.split(flat, r"(?<=[.!?])\s", 2)[0])


def contains_term(term: Column, text: Column) -> Column:
    """Whether a text prints a term, not as part of a longer word or number.

    Terms that begin with a letter are matched in their case, numbers in any;
    curly apostrophes are as straight ones, and any white space stands for a
    space (none, in numbers).
    """
    straight = lambda c: F.translate(c, "’‘", "''")
    number = term.rlike(r"^[-+0-9]")
    quoted = F.transform(F.split(F.trim(straight(term)), r"\s+"), lambda p: F.regexp_replace(p, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"))
    body = F.array_join(quoted, r"\s+")
    loose = F.array_join(quoted, r"\s*")
    pattern = F.concat(F.when(number, F.lit("(?i)")).otherwise(F.lit("")), F.lit("(?<![0-9A-Za-z])"), F.when(number, loose).otherwise(body), F.lit("(?![0-9A-Za-z])"))
    return F.regexp_like(straight(text), pattern)


def citation_header(display_name: Column, number: Column, path: Column, title: Column, paged: Column) -> Column:
    """What stands in front of a passage in the index: where it is from.

    A pageless source has no sections to number: name and title alone.
    """
    trail = F.concat_ws(" › ", F.concat(F.coalesce(path, F.array().cast("array<string>")), F.array(title)))
    numbered = F.concat(F.coalesce(F.concat(F.lit("§"), number, F.lit(" ")), F.lit("")), trail)
    return F.when(paged, F.concat(display_name, F.lit(" — "), numbered)).otherwise(F.concat(display_name, F.lit(" — "), title))


def indexed_text(header: Column, text: Column) -> Column:
    return F.concat_ws("\n", header, text)


def excerpt(text: Column, term: Column, width: int = 90, before: int = 30) -> Column:
    """A window of the text around the first hit in any case; null without one."""
    at = F.call_function("instr", F.lower(text), F.lower(term))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(width)))
