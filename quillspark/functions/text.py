"""Scalar text functions as Column expressions (JVM side, no Python)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
# Dashes that stand for a minus sign between digits.
DASHES = "‒–—−"
# Characters that HTML escapes, the ampersand first.
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#039;"}
#: Characters of one token in the deterministic estimate.
CHARS_PER_TOKEN = 4


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space at both ends, Unicode included."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def lines(x) -> Column:
    """Lines between all line ends that Unicode has; an end at the end of the text
    opens no further line."""
    parts = F.split(col(x), r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def slugify(x, empty: str = "unknown") -> Column:
    """Lower case, every run outside ``a-z0-9`` one hyphen, none at the ends."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit(empty)).otherwise(slug) if empty else slug


def normalize_term(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(x)), r"(?U)\s+", " "))


def tokens(x) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(col(x)), r"(?U)\s+"), lambda t: t != "")


def query_words(x) -> Column:
    """``[a-z0-9]+`` runs of more than two characters, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(col(x)), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) > 2)


def fix_ligatures(x) -> Column:
    out = col(x)
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return out


def clean_whitespace(x) -> Column:
    """Strip every line and make runs of spaces and tabs one space."""
    lines = F.transform(F.split(col(x), r"\R"), lambda s: F.regexp_replace(strip(s), "[ \t]+", " "))
    return F.array_join(lines, "\n")


def normalize_dashes(x) -> Column:
    return F.regexp_replace(col(x), rf"(?<=[0-9^eE])[{DASHES}](?=[0-9])", "-")


def scientific_notation(x) -> Column:
    carets = F.regexp_replace(normalize_dashes(x), r"\^\^+", "^")
    return F.regexp_replace(carets, r"\^\+-", "^-")


def collapse_blank_lines(x) -> Column:
    return F.regexp_replace(col(x), "\n{3,}", "\n\n")


_FENCE = r"^\s*```"
_ITEM = r"^\s*([-*+]|[0-9]+[.)])\s+"
_HEADING = r"^\s*#{1,6}\s+"


def _goes_on(line, before) -> Column:
    """Whether a line outside code continues the line before: that one may not end
    a sentence or open an item or heading, and this one may not be either."""
    plain = ~((strip(line) == "") | line.rlike(_ITEM) | line.rlike(_HEADING)) & (F.length(line) < 120)
    open_end = (before != "") & ~before.rlike(r"[.:?!]$") & ~before.rlike(_ITEM) & ~before.rlike(_HEADING)
    return plain & F.coalesce(open_end, F.lit(False))


def merge_paragraphs(x) -> Column:
    """Join lines that continue the line before.

    A joined line is neither item nor heading, so whether the next one goes on
    depends on its neighbour alone, and every line gets its own separator.  Only
    pages with code fences need a fold, which carries whether a block is open."""
    split = F.split(col(x), r"\R")
    before = F.concat(F.array(F.lit("")), F.slice(split, 1, F.size(split) - 1))
    flat = F.zip_with(split, before, lambda line, last: F.concat(F.when(_goes_on(line, last), " ").otherwise("\n"), line))

    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"), F.lit(False).alias("code"))

    def step(acc, line):
        fence = line.rlike(_FENCE)
        mark = F.when(~fence & ~acc["code"] & _goes_on(line, acc["last"]), " ").otherwise("\n")
        return F.struct(F.concat(acc["out"], F.array(F.concat(mark, line))).alias("out"), line.alias("last"), (acc["code"] != fence).alias("code"))

    fenced = F.aggregate(split, state, step, lambda acc: acc["out"])
    parts = F.when(col(x).rlike(r"(^|\R)" + _FENCE[1:]), fenced).otherwise(flat)
    return F.substring(F.array_join(parts, ""), F.lit(2), F.length(col(x)) + 1)


def cleanup_page(x) -> Column:
    """The whole clean-up of a page but for NFKC, which has no native function;
    see :func:`quillspark.functions.unicode.nfkc`."""
    out = merge_paragraphs(clean_whitespace(fix_ligatures(x)))
    return strip(scientific_notation(collapse_blank_lines(out)))


def word_count(x) -> Column:
    """Words as ``\\w`` runs of letters, digits and underscores."""
    return F.regexp_count(col(x), F.lit(r"[\p{L}\p{N}_]+"))


def poor_text(x, min_chars: int = 50, min_words: int = 8) -> Column:
    return (F.length(strip(x)) < min_chars) | (word_count(x) < min_words)


def better_text(new, old, min_chars: int = 50, min_words: int = 8) -> Column:
    longer = (F.length(strip(new)) > F.length(strip(old))) | (word_count(new) > word_count(old))
    return ~poor_text(new, min_chars, min_words) & longer


def estimate_tokens(x) -> Column:
    return F.ceil(F.length(col(x)) / CHARS_PER_TOKEN).cast("long")


def bm25_idf(n, df) -> Column:
    return F.log(1.0 + (col(n) - col(df) + 0.5) / (col(df) + 0.5))


def safe_file_name(x) -> Column:
    """No characters that file systems refuse, no dots or spaces at the ends."""
    out = F.regexp_replace(F.regexp_replace(col(x), r'[\\/:*?"<>|]', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(out == "", F.lit("document")).otherwise(out)


def safe_stem(x) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), r"(?<=.)\.[^.]*$", ""), "[^A-Za-z0-9_.-]", "_")


def model_id(model, provider) -> Column:
    return F.when(F.instr(col(model), "/") > 0, col(model)).otherwise(F.concat(col(provider), F.lit("/"), col(model)))


def mime_type(name) -> Column:
    ext = F.lower(F.regexp_extract(col(name), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "gif", "image/gif").when(ext == "bmp", "image/bmp").otherwise("image/webp")


def data_url(name, content) -> Column:
    """The content in one line: Spark's base64 breaks lines after 76 characters."""
    return F.concat(F.lit("data:"), mime_type(name), F.lit(";base64,"), F.replace(F.base64(col(content)), F.lit("\r\n"), F.lit("")))


def escape_html(x) -> Column:
    out = F.coalesce(col(x), F.lit(""))
    for sign, entity in ESCAPES.items():
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def answer_paragraphs(x) -> Column:
    """Paragraphs between blank lines, single line breaks kept as ``<br>``."""
    parts = F.filter(F.split(escape_html(x), "\n{2,}"), lambda p: strip(p) != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(strip(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


def hex_to_rgb(x) -> Column:
    part = lambda at: F.conv(F.substring(col(x), at, 2), 16, 10)
    return F.concat_ws(",", part(2), part(4), part(6))


def link_width(weight, highlighted=None) -> Column:
    extra = F.lit(0.0) if highlighted is None else F.when(col(highlighted), 2.0).otherwise(0.0)
    return F.least(1.2 + 2.0 * F.least(col(weight) - 1, F.lit(4)) + extra, F.lit(8.0))


def link_alpha(weight) -> Column:
    return 0.3 + 0.4 * F.least(col(weight) / 3.0, F.lit(1.0))


def display_time(x) -> Column:
    shown = F.date_format(F.try_to_timestamp(col(x)), "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(shown, F.when(col(x) != "", col(x)), F.lit("-"))


def truncate(x, most: int) -> Column:
    text = F.coalesce(col(x), F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def extract_json(x) -> Column:
    """The JSON of a provider's answer: all of it, a fenced block, or from the
    first bracket on; null when none parses."""
    fenced = F.regexp_extract(col(x), r"(?s)```(?:json)?\s*(.*?)```", 1)
    tail = F.regexp_extract(col(x), r"(?s)([{\[].*)$", 1)
    return F.coalesce(F.try_parse_json(col(x)), F.try_parse_json(fenced), F.try_parse_json(tail))


def image_path(content, root, folder) -> Column:
    """A lone image path made absolute against the storage root, else the folder,
    without ``.`` and ``..``."""
    path = strip(content)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.coalesce(col(root), col(folder)), path))
    scheme = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", 0)
    parts = F.split(F.substring(whole, F.length(scheme) + 1, F.length(whole)), "/+")

    def step(out, part):
        up = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(part.isin("", "."), out).when(part == "..", up).otherwise(F.concat(out, F.array(part)))

    return F.concat(scheme, F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def is_image_page(content) -> Column:
    path = strip(content)
    return path.rlike(r"(?i)^.+\.(webp|png|jpe?g|gif|bmp)$") & ~path.contains("\n")
