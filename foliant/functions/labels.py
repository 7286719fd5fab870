"""Column functions: aliases, labels, pages, boxes, noisy text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_present(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in cols))


def canonical_qa(df: DataFrame, aliases: Mapping[str, Sequence[str]], row_id: str) -> DataFrame:
    """Each canonical column from its aliases; list answers are joined by " | "; the id falls back to row_id."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        return F.array_join(c, " | ") if kinds[c].startswith("array") else F.col(c)

    found = {name: first_present(*(text(c) for c in cols if c in kinds)) for name, cols in aliases.items()}
    if "sample_id" in found:
        found["sample_id"] = F.coalesce(found["sample_id"], F.col(row_id).cast("string"))
    return df.withColumns(found)


def reference_pages(value: Column) -> Column:
    """Page numbers of a string: all runs of digits, distinct, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))))


def page_label(deck: Column, page: Column) -> Column:
    """P4."""
    return F.format_string("%s/page_%02d", deck, page.cast("int"))


def page_key(label: Column) -> Column:
    """P5: (deck, n) whatever the zero padding, or null where there is no page number; the last / ends the deck."""
    n = F.regexp_extract(label, r"(?i)page[_-]?(\d+)[^/]*$", 1)
    deck = F.regexp_extract(label, r"^(.*)/[^/]*$", 1)
    return F.when(n != "", F.struct(deck.alias("deck"), n.cast("int").alias("n")))


def normalize_pages(pages: Column, low: int = 1, high: int = 20, most: int = 4) -> Column:
    """Whole numbers in range, in order, each once, the first `most`."""
    return F.slice(F.array_distinct(F.filter(pages, lambda p: p.between(low, high))), 1, most)


def normalize_reference_pages(value: Column, deck: Column) -> Column:
    """A JSON list in a string: numbers become labels of the deck, other strings stay."""
    items = F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
    numbered = F.transform(items, lambda x: F.when(x.rlike(r"^\d+$"), page_label(deck, x)).otherwise(x))
    return F.array_distinct(F.filter(numbered, lambda x: x.isNotNull() & (x != "")))


KEYFACT = "array<struct<page:string,bbox_2d:array<double>>>"


def normalize_keyfacts(value: Column, deck: Column) -> Column:
    """Facts of a JSON list that have a page and a box of four numbers."""
    items = F.coalesce(F.from_json(value, KEYFACT), F.array().cast(KEYFACT))
    good = F.filter(items, lambda f: f["page"].isNotNull() & (F.size(f["bbox_2d"]) == 4) & ~F.exists(f["bbox_2d"], lambda x: x.isNull()))
    label = lambda p: F.when(p.rlike(r"^\d+$"), page_label(deck, p)).otherwise(p)
    return F.transform(good, lambda f: F.struct(label(f["page"]).alias("page"), f["bbox_2d"].alias("bbox_2d")))


def normalize_anchor(value: Column) -> Column:
    """Null, a JSON list or `a|b` as a sorted set."""
    listed = F.from_json(value, "array<string>")
    parts = F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.split(value, r"\|"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))


def normalize_question(text: Column) -> Column:
    """P10."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def question_from_turns(turns: DataFrame, conv: str, order: str, role: str, text: str, marker: str) -> DataFrame:
    """Per conversation, what follows the marker in its user turns, joined in order; null where there is none."""
    said = turns.where(F.col(role) == "user").groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda t: t[text]), "\n").alias("_t"))
    return said.select(conv, F.nullif(F.trim(F.regexp_extract("_t", marker, 1)), F.lit("")).alias("question"))


#: The markers that may stand before a final answer, in order.
ANSWER_MARKERS = ("Final answer:", "Answer:", "答案：", "答案:")


def extract_final_answer(text: Column) -> Column:
    """For each marker in turn, what follows its last occurrence; then without backticks around it."""
    cut = F.trim(F.coalesce(text, F.lit("")))
    for marker in ANSWER_MARKERS:
        cut = F.trim(F.substring_index(cut, marker, -1))
    return F.regexp_replace(cut, r"^`+|`+$", "")


def extract_json(text: Column) -> Column:
    """From the first { to the last }, if that is JSON."""
    found = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def hop(pages: Column, explicit: Column | None = None) -> Column:
    """An explicit class first; else multi for two or more pages."""
    derived = F.when(F.size(pages) >= 2, "multi").otherwise("single")
    return derived if explicit is None else F.coalesce(first_present(explicit), derived)


def safe_name(text: Column, most: int = 120) -> Column:
    """P15."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_"), 1, most), F.lit("")), F.lit("_"))


def image_ext(data: Column) -> Column:
    """By magic bytes: JPEG, PNG, WEBP; anything else is an error."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.rlike("^52494646.{8}57454250"), "webp").otherwise(F.raise_error(F.lit("unknown image kind")).cast("string"))
    )


def compact_unique(items: Column, ignore_case: bool = False) -> Column:
    """Each once, in order; the second form compares without case and with white space collapsed, and drops empty ones."""
    if not ignore_case:
        return F.array_distinct(items)
    tidy = F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    is_first = lambda x, i: F.array_position(F.transform(tidy, F.lower), F.lower(x)) == i + 1
    marked = F.transform(tidy, lambda x, i: F.struct(x.alias("x"), is_first(x, i).alias("first")))
    return F.transform(F.filter(marked, lambda s: s["first"]), lambda s: s["x"])


def cells_to_labels(cells: Column) -> tuple[Column, Column]:
    """Names A1..H8 as 64 zeros and ones, row by row, and how many names are none."""
    names = F.transform(cells, lambda c: F.upper(F.trim(c)))
    good = F.filter(names, lambda c: c.rlike("^[A-H][1-8]$"))
    index = F.transform(good, lambda c: (F.ascii(F.substring(c, 1, 1)) - 65) * 8 + F.substring(c, 2, 1).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array_contains(index, i).cast("float")), F.size(names) - F.size(good)


def compact_error(text: Column, most: int = 220) -> Column:
    """P19."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


#: What marks an error of the service rather than of the answer.
API_MARKERS = (
    "api ", "quota", "balance", "rate limit", "rate_limit", "too many requests", "billing",
    "invalid api key", "model not found", "no permission", "access denied", "forbidden", "http 5",
)


def api_error(errors: Column, judge_error: Column, markers: Sequence[str] = API_MARKERS) -> Column:
    """P20: the first trace error that isn't empty, else the judge's, if it holds a marker in any case."""
    first = F.coalesce(F.get(F.filter(errors, lambda e: e.isNotNull() & (e != "")), F.lit(0)), judge_error)
    return F.when(F.lower(first).rlike("|".join(markers)), first)


def scrub(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns go, white space is collapsed."""
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def to_conversations(messages: Column, target: Column) -> Column:
    """System, user and assistant as system, human and gpt; the target is the last."""
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    turns = F.transform(messages, lambda m: F.struct(name(m["role"]).alias("from"), m["content"].alias("value")))
    return F.concat(turns, F.array(F.struct(F.lit("gpt").alias("from"), target.alias("value"))))


def to_rl_rows(qa: DataFrame, source: str) -> DataFrame:
    """Question, answer, deck, evidence (labels), sample_id as nested rows."""
    return qa.select(
        F.lit(source).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("prompt"), F.lit("doc_qa").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"),
        F.struct(F.col("sample_id"), hop(F.col("evidence")).alias("hop")).alias("extra_info"),
        F.struct(F.col("deck"), F.col("question"), F.to_json("evidence").alias("reference_pages")).alias("env_kwargs"),
    )


def rewrite_prefix(path: Column, prefixes: Sequence[str], root: str) -> Column:
    """The first matching prefix becomes root; a path under none is an error."""
    out = F.raise_error(F.concat(F.lit("not under the corpus: "), path)).cast("string")
    for p in reversed(prefixes):
        out = F.when(path.startswith(p), F.concat(F.lit(root), F.substring(path, len(p) + 1, 1 << 30))).otherwise(out)
    return out


#: A shown image's grid, least and most pixels; the least side of a box as shown.
GRID, LEAST_PIXELS, MOST_PIXELS, LEAST_SIDE = 28, 256 * 28 * 28, 512 * 28 * 28, 4


def shown_size(w: Column, h: Column, grid: int = GRID, least: int = LEAST_PIXELS, most: int = MOST_PIXELS) -> Column:
    """P25: a page's size as shown: whole multiples of the grid, nearest (halves to even) if that keeps the pixel budget,
    else scaled down and floored or scaled up and ceiled.
    """
    near = lambda x: F.greatest(F.bround(x / grid) * grid, F.lit(float(grid)))
    down = F.sqrt(w * h / most)
    up = F.sqrt(F.lit(float(least)) / (w * h))
    pixels = near(w) * near(h)
    side = lambda x: F.when(pixels > most, F.greatest(F.floor(x / down / grid) * grid, F.lit(grid))).when(pixels < least, F.ceil(x * up / grid) * grid).otherwise(near(x)).cast("long")
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def unit_box(box: Column, w: Column, h: Column, per_mille: bool = False) -> Column:
    """P25: a box on an image shown at w x h, in its pixels or in thousandths, as clamped parts of it.

    Null where a number is missing or less than LEAST_SIDE shown pixels are left either way.
    """
    def part(i: int, size: Column) -> Column:
        scale = F.lit(1000.0) if per_mille else size.cast("double")
        return F.greatest(F.lit(0.0), F.least(scale, F.get(box, F.lit(i)).cast("double"))) / scale

    unit = F.array(part(0, w), part(1, h), part(2, w), part(3, h))
    wide = ((unit[2] - unit[0]) * w >= LEAST_SIDE) & ((unit[3] - unit[1]) * h >= LEAST_SIDE)
    sound = (F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return F.when(sound & wide, unit)


def page_box(unit: Column, w: Column, h: Column) -> Column:
    """P25: parts of a page as whole pixels, halves to even."""
    return F.array(*(F.bround(unit[i] * size).cast("double") for i, size in ((0, w), (1, h), (2, w), (3, h))))


def box_in_zoom(unit: Column, zoom: Column) -> Column:
    """P25: parts of a zoomed region (itself parts of the page) as parts of the page."""
    return F.array(*(zoom[i % 2] + unit[i] * (zoom[i % 2 + 2] - zoom[i % 2]) for i in range(4)))


def crop_region(box: Column, w: Column, h: Column, pad: int = 28, most_aspect: float = 180.0) -> Column:
    """The box widened by pad, whole pixels outwards, inside the page; null where it is empty or too long."""
    x1, y1 = F.greatest(F.floor(box[0] - pad), F.lit(0)), F.greatest(F.floor(box[1] - pad), F.lit(0))
    x2, y2 = F.least(F.ceil(box[2] + pad), w.cast("long")), F.least(F.ceil(box[3] + pad), h.cast("long"))
    dx, dy = x2 - x1, y2 - y1
    return F.when((dx > 0) & (dy > 0) & (F.greatest(dx, dy) <= most_aspect * F.least(dx, dy)), F.array(x1, y1, x2, y2))


def parse_index_paths(spec: Column) -> Column:
    """`a=path,b=path` as a map."""
    return F.str_to_map(spec, F.lit(","), F.lit("="))


def index_path(paths: Column, corpus: Column) -> Column:
    """The corpus's path; an unknown corpus is an error."""
    return F.coalesce(F.try_element_at(paths, corpus), F.raise_error(F.concat(F.lit("unknown corpus "), corpus)).cast("string"))


def unfold_chunks(df: DataFrame, n: int, cols: Sequence[str]) -> DataFrame:
    """One row for each of n equal pieces of the array columns; the others repeat. Sizes must be multiples of n."""
    def piece(c: str, i: Column) -> Column:
        width = (F.size(c) / n).cast("int")
        return F.slice(F.col(c), i * width + 1, width)

    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk")
    out = df.select("*", i)
    return out.withColumns({c: piece(c, F.col("chunk")) for c in cols})
