"""Column functions over text: profiling, cleaning, tokens, labels. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"[가-힣A-Za-z0-9_]+"
_WS_CONTROL = r"[\t\n\x0B\f\r\x1c-\x1f\x{85}]"


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def control_chars(text: Column) -> Column:
    """Characters of the Unicode categories C*, white space aside."""
    return F.regexp_count(text, F.lit(r"\p{C}")) - F.regexp_count(text, F.lit(_WS_CONTROL))


def text_quality(text: Column) -> Column:
    """struct(chars, control, control_ratio, letter_ratio, quality, reasons) of a page's text.

    Empty text is 'empty'; more than 2 % control characters, or under 20 % letters and digits in 40 characters or more, make it 'degraded'.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.length(t)
    control = control_chars(t)
    control_ratio = F.round(ratio(control, n), 6)
    letters = F.round(ratio(F.regexp_count(t, F.lit(r"[\p{L}\p{Nd}]")), n), 6)
    reasons = F.array_compact(F.array(F.when(control_ratio > 0.02, F.lit("high_control_char_ratio")), F.when((n >= 40) & (letters < 0.2), F.lit("low_letter_or_number_ratio"))))
    quality = F.when(n == 0, "empty").when(F.size(reasons) > 0, "degraded").otherwise("good")
    return F.struct(n.alias("chars"), control.alias("control"), control_ratio.alias("control_ratio"), letters.alias("letter_ratio"), quality.alias("quality"), F.when(n == 0, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))


def cjk_ratio(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.round(ratio(F.regexp_count(t, F.lit(r"[\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}]")), F.length(t)), 6)


def casefold(text: Column) -> Column:
    """Lower case in which the letters count as equal that have no upper case of one letter, or two lower ones."""
    return F.replace(F.translate(F.lower(text), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def clean_lines(text: Column) -> Column:
    """Every line stripped, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def squeeze_ws(text: Column) -> Column:
    """Runs of white space, Unicode's included, as one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trim_ellipsis(text: Column, limit: int) -> Column:
    """Cut to limit - 1 characters plus dots, which may exceed the limit by 2."""
    t = squeeze_ws(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("...")))


def trim_context(text: Column, limit: int) -> Column:
    """Cut to limit characters, the dots included; up to three characters only dots."""
    t = F.trim(text)
    if limit <= 3:
        return F.when(F.length(t) <= limit, t).otherwise(F.lit("." * max(limit, 0)))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def trim_query(text: Column, limit: int) -> Column:
    """Cut at limit, then back to the last space."""
    t = squeeze_ws(text)
    cut = F.substring(t, 1, limit)
    return F.when(F.length(t) <= limit, t).when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)


def word_tokens(text: Column, lower: bool = True) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    return F.transform(words, lambda x: F.lower(x)) if lower else words


def char_ngrams(text: Column, low: int = 2, high: int = 3, cjk_only: bool = False) -> Column:
    """Per word, its n-grams of low to min(high, length) characters, short ones first."""
    if not 0 < low <= high:
        raise ValueError("need 0 < low <= high")

    def of(word: Column, n: int) -> Column:
        return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    words = word_tokens(text)
    if cjk_only:
        words = F.filter(words, lambda w: w.rlike(r"[가-힣\x{4E00}-\x{9FFF}]"))
    return F.flatten(F.transform(words, lambda w: F.concat(*[of(w, n) for n in range(low, high + 1)])))


def mixed_tokens(text: Column, low: int = 2, high: int = 3, dedupe: bool = True) -> Column:
    both = F.concat(word_tokens(text), char_ngrams(text, low, high))
    return F.array_distinct(both) if dedupe else both


def audit_terms(text: Column) -> Column:
    """Distinct terms of a query: Latin words from two characters, Hangul and Han runs, numbers. Lower case stands for casefold."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_]+|[가-힣]{2,}|[一-龥]{2,}|[0-9]{2,}"), F.lit(0)), lambda x: F.lower(x)))


#: Lines that hold one of these stand for a page without text.
PLACEHOLDERS = ("OCR/VLM processing required", "Full page render for page")


def normalise_query(text: Column) -> Column:
    """Markdown marks to spaces, white space squeezed."""
    return squeeze_ws(F.regexp_replace(text, r"[|#*_`>\[\]()]", " "))


def meaningful_text(text: Column) -> Column:
    """normalise_query() of the lines that are no placeholder."""
    kept = F.filter(F.split(text, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda x: ~(F.contains(x, F.lit(PLACEHOLDERS[0])) | F.contains(x, F.lit(PLACEHOLDERS[1]))))
    return normalise_query(F.array_join(kept, " "))


def context_prefix(section: Column, first: Column, last: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Section: "), section), F.concat(F.lit("Page range: "), first.cast("string"), F.lit("-"), last.cast("string")))


def with_prefix(text: Column, prefix: Column) -> Column:
    return F.when(F.startswith(text, prefix), text).otherwise(F.concat(prefix, F.lit("\n\n"), text))


def section_label(section: Column) -> Column:
    return F.concat_ws(" > ", *[F.nullif(section[x], F.lit("")) for x in ("chapter", "section", "subsection", "issue")])


def tile_label(i: Column, n: Column, row: Column, col: Column) -> Column:
    return F.format_string("%d/%d, row %d col %d", i + 1, n, row + 1, col + 1)


def normalise_entity(label: Column) -> Column:
    """Quotes and outer space off, white space squeezed. NFKC is left to text that isn't ASCII or Latin-1 by norm_entity()."""
    return squeeze_ws(F.regexp_replace(F.trim(label), "^[\"'`“”‘’]+|[\"'`“”‘’]+$", ""))


def normalise_predicate(label: Column) -> Column:
    t = F.regexp_replace(F.lower(normalise_entity(label)), r"(?U)[^\w]+", "_")
    return F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_+|_+$", "")


def triple_text(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat_ws(" ", subject, F.replace(predicate, F.lit("_"), F.lit(" ")), obj)


def graph_text(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(label), F.lit("_"), F.lit(" ")), r"\s+", " "))


def bbox_region(box: Column) -> Column:
    """Name of the ninth of the page that the box's centre is in; null unless the box lies within [0, 1] and has an extent."""
    at = lambda b, i: F.get(b, F.lit(i))
    third = lambda v, names: F.when(v < 1 / 3, names[0]).when(v > 2 / 3, names[2]).otherwise(names[1])

    def name(b: Column) -> Column:
        centre = F.struct(((at(b, 0) + at(b, 2)) / 2).alias("x"), ((at(b, 1) + at(b, 3)) / 2).alias("y"))
        named = F.transform(F.array(centre), lambda c: F.concat_ws(" ", third(c["y"], ("upper", "middle", "lower")), third(c["x"], ("left", "center", "right"))))[0]
        valid = (F.size(b) == 4) & (at(b, 0) >= 0) & (at(b, 1) >= 0) & (at(b, 2) <= 1) & (at(b, 3) <= 1) & (at(b, 2) > at(b, 0)) & (at(b, 3) > at(b, 1))
        return F.when(valid, F.regexp_replace(named, "^middle center$", "center"))

    return F.transform(F.array(box), name)[0]


def source_family(source: Column) -> Column:
    """What kind of evidence a hit's source gives, as metrics group it."""
    s = F.lower(F.trim(source))
    has = lambda *names: F.greatest(*[F.contains(s, F.lit(n)) for n in names]) if len(names) > 1 else F.contains(s, F.lit(names[0]))
    return (
        F.when(has("triple_dense"), "graph")
        .when(has("caption_dense", "object_dense", "image_dense"), "visual")
        .when((s == "dense") | has("text_dense"), "dense_text")
        .when(F.startswith(s, F.lit("rerank:")), "reranker")
        .when((s == "bm25") | has("lexical"), "lexical")
        .when(s == "graph", "graph")
        .when(s == "", "unknown")
        .otherwise(F.substring_index(s, ":", 1))
    )


def fusion_family(source: Column) -> Column:
    """What a weight may be given to besides the source itself: its name up to the first colon."""
    return F.substring_index(source, ":", 1)


def confidence(value: Column, *, percent: bool = False, strict: bool = False) -> Column:
    """A confidence within 0..1: clamped; with percent, one per cent sign at the end goes and what lies above 1 and up to 100 is divided by 100; with strict, what lies
    outside is null. What is no number is null, 85% without percent too."""
    t = F.trim(value.cast("string"))
    v = (F.trim(F.regexp_replace(t, "%$", "")) if percent else t).try_cast("double")
    if percent:
        v = F.when((v > 1) & (v <= 100), v / 100).otherwise(v)
    return F.when((v >= 0) & (v <= 1), F.round(v, 6)) if strict else F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def table_cells(cells: Column) -> Column:
    """Cells with white space squeezed, rows padded to one width; rows and columns without any text go."""
    tidy = F.transform(cells, lambda r: F.transform(r, lambda c: squeeze_ws(F.coalesce(c, F.lit("")))))
    rows = F.filter(tidy, lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    at = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    columns = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(columns, lambda i: F.exists(rows, lambda r: at(r, i) != ""))
    return F.transform(rows, lambda r: F.transform(kept, lambda i: at(r, i)))


def table_markdown(table: Column) -> Column:
    """table_cells() as Markdown: pipes escaped; the first row heads it. Null without a row."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(table[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(table) > 0, F.array_join(F.concat(F.array(line(table[0]), rule), F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(1))), line)), "\n"))


def table_useful(table: Column, rows: int = 2, cols: int = 2, control: float = 0.02) -> Column:
    """Whether table_cells() has enough rows and columns, rows * cols filled cells, and few control characters."""
    flat = F.flatten(table)
    width = F.coalesce(F.array_max(F.transform(table, lambda r: F.size(r))), F.lit(0))
    text = F.array_join(flat, "")
    return (F.size(table) >= rows) & (width >= cols) & (F.size(F.filter(flat, lambda c: c != "")) >= rows * cols) & (ratio(control_chars(text), F.length(text)) <= control)


def page_kind(page_no: Column, images: Column, drawings: Column) -> Column:
    """What a rendered page is taken for."""
    return F.when(page_no <= 3, "page_image").when(images >= 4, "map").when(drawings >= 20, "table").when(images >= 1, "figure").otherwise("page_image")


def worth_rendering(quality: Column, images: Column, drawings: Column) -> Column:
    """Whether a page has something to see, or no good text."""
    return quality.isin("empty", "degraded") | (images > 0) | (drawings >= 20)


def visual_score(blocks: Column, embedded: Column, drawings: Column) -> Column:
    return 5 * blocks + 3 * embedded + drawings


def tiling_reasons(images: Column, drawings: Column, quality: Column, score: Column) -> Column:
    return F.array_compact(F.array(F.when(images >= 8, F.lit("many_images")), F.when(drawings >= 30, F.lit("many_drawings")), F.when((quality == "empty") & (score >= 20), F.lit("empty_visual_page"))))


def complexity_bonus(blocks: Column, embedded: Column, drawings: Column) -> Column:
    cap = lambda c, n: F.least(F.coalesce(c, F.lit(0)), F.lit(n))
    return cap(blocks, 5) * 40 + cap(embedded, 5) * 40 + cap(drawings, 20) * 5


def job_priority(kind: Column, needs_vlm: Column, needs_ocr: Column, bonus: Column, is_tile: Column, is_empty: Column, has_section: Column) -> Column:
    base = F.when(kind == "map", 1000).when(kind == "table", 900).when(kind == "chart", 850).when(kind == "figure", 800).when(kind == "page_image", 650).otherwise(500)
    flag = lambda c, v: F.when(c, v).otherwise(0)
    return base + flag(needs_vlm, 200) + flag(needs_ocr, 100) + bonus + flag(is_tile, 80) + flag(is_empty, 50) + flag(has_section, 20)


def question(term: Column) -> Column:
    """A question about a term, in the language its letters suggest."""
    return F.when(term.rlike("[가-힣]"), F.concat(F.lit("어디에서 "), term, F.lit(" 관련 항목을 찾을 수 있는가"))).otherwise(F.concat(F.lit("Where is "), term, F.lit(" discussed?")))
