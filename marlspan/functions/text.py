"""Text column functions: options, answer letters, templates, families, slugs, ids."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numeric import col

LETTERS = "ABCDEFGH"


def option_map(text: Column | str, separator: str = ";") -> Column:
    """'A: x; B: y' or 'A. x' to a map; null if an option is malformed, empty or repeated, or fewer than two are there."""
    parts = F.filter(F.transform(F.split(col(text), separator), lambda p: F.trim(p)), lambda p: p != "")
    letter = lambda p: F.regexp_extract(p, r"^([A-Z])\s*[:.]\s*(.+)$", 1)
    body = lambda p: F.trim(F.regexp_extract(p, r"^([A-Z])\s*[:.]\s*(.+)$", 2))
    letters = F.transform(parts, letter)
    good = F.forall(parts, lambda p: (letter(p) != "") & (body(p) != "")) & (F.size(F.array_distinct(letters)) == F.size(letters)) & (F.size(letters) >= 2)
    return F.when(good, F.map_from_arrays(letters, F.transform(parts, body)))


def option_list_map(options: Column | str) -> Column:
    """An array of 'A. x', 'B) y' or plain texts to a map; null if a place beyond H has to name an option.

    An option without a letter, or with one that is taken by then, takes the letter of its place, and stays whole.
    The letter of a place overrides an option that has it already.
    """
    options = col(options)
    pattern = r"(?s)^\s*([A-Za-z])\s*[.):]\s*(.*)$"
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")

    def add(done: Column, i: Column) -> Column:
        text = F.element_at(options, i)
        letter = F.upper(F.regexp_extract(text, pattern, 1))
        named = (letter != "") & ~F.exists(done, lambda e: e["k"] == letter)
        place = F.substring(F.lit(LETTERS), i, F.lit(1))
        key = F.when(named, letter).otherwise(place)
        value = F.when(named, bare(F.regexp_extract(text, pattern, 2))).otherwise(bare(text))
        return F.concat(F.filter(done, lambda e: e["k"] != key), F.array(F.struct(key.alias("k"), value.alias("v"))))

    none = F.array().cast("array<struct<k:string,v:string>>")
    entries = F.aggregate(F.sequence(F.lit(1), F.size(options)), none, add)
    return F.when(F.size(options) == 0, F.map_from_entries(none)).when(~F.exists(entries, lambda e: e["k"] == ""), F.map_from_entries(entries))


def map_text(m: Column | str) -> Column:
    """A map as 'k=v;k=v' by key."""
    m = col(m)
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), F.element_at(m, k))), ";")


#: From the most to the least explicit way to name a letter.
CHOICE_PATTERNS = (
    r"<answer>\s*([A-Za-z])\s*</answer>",
    r"<\s*([A-Za-z])\s*(?![A-Za-z])",
    r"^\**\s*([A-Za-z])\s*[.):,]",
    r"^\**\s*([A-Za-z])\**\s*$",
    r"\banswer\s*(?:is)?\s*[:\-]?\s*([A-Za-z])\b",
)


def choice_letter(text: Column | str, letters: str = "ABCD") -> Column:
    """The letter that the first fitting pattern names, if it is offered; only a pattern's first match counts."""
    found, text = [], F.trim(col(text))
    for pattern in CHOICE_PATTERNS:
        letter = F.upper(F.regexp_extract(text, f"(?im){pattern}", 1))
        found.append(F.when(letter.isin(*letters), letter))
    return F.coalesce(*found)


def letter_or_token(text: Column | str, letters: str = "ABCD") -> Column:
    """choice_letter(), else the first letter that stands alone."""
    bare = F.regexp_extract(col(text), r"\b([A-D])\b", 1)
    return F.coalesce(choice_letter(text, letters), F.when(bare != "", bare))


def strict_letter(text: Column | str) -> Column:
    """The letter inside answer tags alone."""
    letter = F.upper(F.regexp_extract(col(text), r"(?i)<answer>\s*([A-D])\s*</answer>", 1))
    return F.when(letter != "", letter)


def template(text: Column | str) -> Column:
    """The wording without what is incidental: possessive subjects, numbers, signs, case, white space."""
    out = F.translate(col(text), "\u2018\u2019", "''")
    for pattern, to in ((r"(?i)\bthe\s+[a-z][a-z '_-]{0,30}?'s\b", "the SUBJ's"), (r"\d+(\.\d+)?", "N"), (r"[^A-Za-z' ]", " "), (r" +", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.lower(F.trim(out))


#: Nouns that name a question's subject.
SUBJECT_NOUNS = (
    "character", "woman", "man", "kid", "person", "camera", "dog", "cat", "boy", "girl", "car", "horse", "plane", "motorbike",
    "race car", "boat", "cyclist", "truck", "seal", "sailboat", "skier", "vehicle",
)


def noun_template(text: Column | str, nouns: tuple[str, ...] = SUBJECT_NOUNS) -> Column:
    """Possessive subjects first, then the nouns, to one mark."""
    out = F.regexp_replace(col(text), r"\bthe\s+[a-zA-Z][a-zA-Z '_-]*?'s\b", "the SUBJ's")
    return F.regexp_replace(out, rf"(?i)\b({'|'.join(nouns)})\b", "SUBJ")


@dataclass(frozen=True)
class Family:
    """A named rule; `on` is the text that it reads."""

    name: str
    pattern: str
    on: str = "question"

    def matches(self, question: Column, options: Column) -> Column:
        return F.coalesce((options if self.on == "options" else question).rlike(f"(?i){self.pattern}"), F.lit(False))


#: Question families in order of precedence.
FAMILIES = (
    Family("metric_speed", r"\bm\s*/\s*s\b|\bmeters? per second\b|\bkm\s*/\s*h\b|\bmph\b", "options"),
    Family("metric_distance", r"\b\d+(\.\d+)?\s*(m|meters?|metres?|cm|centimet\w+|feet|ft)\b", "options"),
    Family("instance_count", r"\bhow many\b"),
    Family("event_order", r"\b(happens?|comes?|occurs?|occurred)\s+first\b|\bfirst[:,]|\bwhich event\b"),
    Family("timestamped", r"\b\d+(\.\d+)?\s*(s|secs?|seconds?)\b"),
    Family("apparent_size", r"apparent size|appear\w*\s+(larger|smaller|bigger)|larger or smaller|visually appear|occupy|\bsize\b.{0,25}\bframe\b"),
    Family("camera_zoom", r"\bzoom"),
    Family("camera_shake", r"\bshak\w*|\bjitter|\bstabili\w*|\bwobbl"),
    Family("camera_rhythm", r"movement speed|movement rhythm|\brhythm\b|speed .{0,20}camera|camera.{0,30}\bspeed\b"),
    Family("shooting_angle", r"shooting angle|camera angle|\b(high|low)[- ]angle|eye[- ]?level|which side of the"),
    Family("subject_orientation", r"\borientation\b|\bfacing\b|\bfaces?\s+(toward|away|the)|which (way|direction).{0,20}(face|point)|\bheading\b"),
    Family("visibility", r"\b(in|out of|leaves?|left|enters?|entered|exits?)\s+the\s+frame\b|still (visible|in frame)|remains? visible|(which|what) (area|part|region|portion) of the frame"),
    Family("scene_revisit", r"\b(scene|background|environment|location)\b.{0,40}\bsame\b|same (scene|background|place|location|environment)|returns? to the (same|start)"),
    Family("camera_subject_distance", r"distance between the camera|camera.{0,30}\bdistance\b|\bdistance\b.{0,30}camera"),
    Family("camera_trajectory", r"\bcamera\b.{0,40}\b(trajectory|movement|motion|moves?|moved|pans?|tilts?|dollies|orbit\w*|rotat\w*|travel\w*|remain\w*|fixed|static|still)\b|\b(trajectory|movement|motion|path|pan|tilt|dolly|orbit\w*)\b.{0,40}\bcamera\b"),
    Family("motion_continuity", r"continuous\w*|intermittent\w*|only (once )?briefly|remains? stationary|stationary or move|interrupted by pause|\bpauses?\b"),
    Family("object_object_relation", r"relative to the|with respect to|in relation to|spatial relationship|between the .{2,40} and the |closer to (each other|one another)|(farther|further) apart|closer together"),
    Family("subject_trajectory", r"(position|movement|direction|trajectory|path|motion)\b.{0,40}(change|shift|evolve)|how does the .{2,40} (move|travel|go)\b|direction of the"),
    Family("activity_semantic", r"best describes|main activity|what is happening|what happens to the|composition|posture|appearance|expression|focus|impression|atmosphere"),
)


def family(question: Column | str, options: Column | str, families: tuple[Family, ...] = FAMILIES) -> Column:
    """The first family that matches, else 'unfamilied'."""
    out = F.lit("unfamilied")
    for f in reversed(families):
        out = F.when(f.matches(col(question), col(options)), F.lit(f.name)).otherwise(out)
    return out


def all_families(question: Column | str, options: Column | str, families: tuple[Family, ...] = FAMILIES) -> Column:
    """Every family that matches, in order."""
    return F.array_compact(F.array(*(F.when(f.matches(col(question), col(options)), F.lit(f.name)) for f in families)))


def slug(path: Column | str, length: int = 60, digest: int = 8) -> Column:
    """A file name for a path: lower case, no extension, runs of spaces and slashes to one mark, other dots kept, the end of it, and a digest."""
    stem = F.regexp_replace(F.lower(col(path)), r"\.[^.]*$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"[\s/]+", "_"), "[^a-z0-9._-]", "")
    stem = F.regexp_replace(F.right(F.regexp_replace(stem, "^_+|_+$", ""), F.lit(length)), "^_+|_+$", "")
    return F.concat(stem, F.lit("_"), F.left(F.sha1(col(path).cast("binary")), F.lit(digest)))


def subject_key(subject: Column | str) -> Column:
    """A short readable stem, one mark for each other character, and a digest, both of the trimmed lower-case text; null and empty are 'camera_only'."""
    plain = F.lower(F.regexp_replace(col(subject), r"^\s+|\s+$", ""))
    stem = F.regexp_replace(F.left(F.regexp_replace(plain, r"[^\p{L}\p{N}]", "_"), F.lit(32)), "^_+|_+$", "")
    return F.when(F.coalesce(col(subject), F.lit("")) == "", "camera_only").otherwise(F.concat(stem, F.lit("_"), F.left(F.sha1(plain.cast("binary")), F.lit(10))))


@F.arrow_udf(StringType())
def normal_key(text: pa.Array) -> pa.Array:
    """NFKC, trimmed, white space collapsed, case folded; what is not ASCII goes one by one."""
    wide = pc.invert(pc.fill_null(pc.string_is_ascii(text), True))
    out = pc.utf8_lower(pc.replace_substring_regex(pc.utf8_trim_whitespace(text), r"[\s\x0B\x1C-\x1F]+", " "))
    if not pc.any(wide).as_py():
        return out
    folded = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).strip()).casefold() for t in text.filter(wide).to_pylist()]
    return pc.replace_with_mask(out, wide, pa.array(folded, pa.string()))


def composite_id(*parts: Column | str, length: int = 12) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *(col(p).cast("string") for p in parts)), 256), F.lit(length))


def percent(part: Column | str, whole: Column | str) -> Column:
    """'12.3%', or a dash without a whole."""
    return F.coalesce(F.concat(F.round(F.try_divide(100 * col(part), col(whole)), 1).cast("decimal(6,1)").cast("string"), F.lit("%")), F.lit("-"))


def clamp(label: Column | str, allowed: tuple[str, ...], other: str = "OTHER") -> Column:
    return F.when(col(label).isin(*allowed), col(label)).otherwise(F.lit(other))


def wrapped(text: Column | str, width: int) -> Column:
    """Lines of at most `width` characters, as many words in each as fit; white space becomes single spaces or line ends, and a longer word is broken."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(plain, rf"(.{{1,{width}}})(?: |$)|(.{{{width}}})", "$1$2\n"), r"\n$", "")


def split_at(text: Column | str, start: Column | str, end: Column | str) -> tuple[Column, Column, Column]:
    """What stands before a span, in it and after it (0-based, end exclusive)."""
    text, start, end = col(text), col(start), col(end)
    return F.left(text, start), F.substring(text, start + 1, end - start), F.substring(text, end + 1, F.length(text) - end)
