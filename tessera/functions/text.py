"""Scalar text functions: Column in, Column out, null stays null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators, markers, labels, word lists and names that data and prompts of this kind carry.
SEP = "<x>SEP</x>"
EOI = "##EOI##"
EOS = "##EOS##"
NO_INPUT = "<noinput>"
EVOLVED = "#Finally Rewritten Instruction#:"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLACKLISTS = {
    "EN": ["image", "images", "graph", "graphs", "picture", "pictures", "file", "files", "map", "maps", "draw", "plot", "go to", "video", "audio", "music", "flowchart", "diagram"],
    "HU": ["kép", "képek", "grafikon", "grafikonok", "filé", "fájlok", "mappa", "térképek", "húzni", "telek", "menni", "videó", "hang", "zene", "folyamatábra", "diagram"],
    "DE": ["Bild", "Bilder", "Graph", "Graphen", "Datei", "Dateien", "Karte", "Karten", "Zeichnen", "Plotten", "Gehe zu", "Video", "Audio", "Musik", "Flussdiagramm", "Diagramm"],
}
LABELS = {
    "EN": ("Instruction", "Input", "Output"),
    "DE": ("Anweisung", "Eingabe", "Ausgabe"),
    "HU": ("Utasítás", "Bemenet", "Kimenet"),
}
LANGUAGES = {
    "EN": "English", "BG": "Bulgarian", "DA": "Danish", "DE": "German", "ET": "Estonian", "FI": "Finnish", "FR": "French", "EL": "Greek", "IT": "Italian", "LV": "Latvian", "LT": "Lithuanian",
    "NL": "Dutch", "PL": "Polish", "PT": "Portuguese", "RO": "Romanian", "SV": "Swedish", "SK": "Slovak", "SL": "Slovenian", "ES": "Spanish", "CS": "Czech", "HU": "Hungarian",
}
GREETINGS = ["Hi!", "Hello", "Heya", "Good morning"]


def strip(c: Column) -> Column:
    """Removes white space at both ends, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are stripped, then trailing colons."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), ":+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def truncate_words(c: Column, budget: int | Column) -> Column:
    """The first ``budget`` words joined by spaces (O113), a number or one for each row, such as what a prompt leaves; where nothing is left the text
    stays as it is, and so does a null budget's."""
    left = F.lit(budget) if isinstance(budget, int) else budget.cast("int")
    return F.when(left > 0, F.array_join(F.slice(words(c), F.lit(1), F.greatest(left, F.lit(1))), " ")).otherwise(c)


def encode_no_input(c: Column) -> Column:
    return F.when(c == "", NO_INPUT).otherwise(c)


def decode_no_input(c: Column) -> Column:
    return F.when(F.lower(c) == NO_INPUT, "").otherwise(c)


def unescape_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def restore_entities(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def strip_qa_prefix(c: Column) -> Column:
    """Strips leading characters of the sets "Q: " and "A: ", in this order (O107)."""
    return F.ltrim(F.ltrim(c, F.lit("Q: ")), F.lit("A: "))


def trim_stops(c: Column, stops: list[str]) -> Column:
    """Drops one stop string at the end and <pad> anywhere, then strips (O124)."""
    quoted = "|".join("\\Q" + s + "\\E" for s in stops)
    return strip(F.regexp_replace(F.replace(c, F.lit("<pad>"), F.lit("")), f"(?:{quoted})$", ""))


def clean_titles(c: Column) -> Column:
    """Strips, turns " [title]" into ". ", drops [bracketed] text, and makes one pass from two spaces to one (O105)."""
    return F.replace(F.regexp_replace(F.replace(strip(c), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def pack_blank(c: Column) -> Column:
    """Marks the first blank of a sentence for translation; only the pieces around it are kept (O104)."""
    parts = F.split(c, "_")
    return F.concat(parts[0], F.lit("<x>_</x>"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def pack(*parts: Column, trailing: bool = False, sep: str = SEP) -> Column:
    """Arrays of strings joined into one translatable string (O103); wrap single strings by ``F.array``."""
    joined = F.array_join(F.concat(*parts), sep)
    return F.concat(joined, F.lit(sep)) if trailing else joined


def unpack(c: Column, sep: str = SEP, trailing: bool = False) -> Column:
    parts = F.split(c, "\\Q" + sep + "\\E", -1)
    return F.slice(parts, 1, F.size(parts) - 1) if trailing else parts


def part_count(c: Column, sep: str = SEP) -> Column:
    return F.size(unpack(c, sep)).cast("long")


def rewrite_language(data_id: Column, lang: Column) -> Column:
    """Replaces the third token of an id like a_b_en_1."""
    s = F.split(data_id, "_")
    return F.array_join(F.concat(F.slice(s, 1, 2), F.array(F.lower(lang)), F.slice(s, 4, F.greatest(F.size(s) - 3, F.lit(0)))), "_")


def next_number(data_id: Column) -> Column:
    """The id with its last number one higher."""
    s = F.split(data_id, "_")
    return F.array_join(F.concat(F.slice(s, 1, F.size(s) - 1), F.array((F.element_at(s, -1).cast("long") + 1).cast("string"))), "_")


def recode_role(c: Column) -> Column:
    return F.when(c == "human", "user").otherwise("assistant")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(" vs "), F.greatest(a, b))


def verdict(c: Column, model1: Column, model2: Column) -> Column:
    """The text before the end marker, mapped to a model where it names one (O108)."""
    said = strip(F.split(c, EOS, -1)[0])
    return F.when(said == "Translation (a)", model1).when(said == "Translation (b)", model2).otherwise(said)


def repair_winner(c: Column, model1: Column, model2: Column) -> Column:
    """Maps what begins like a verdict, with or without its closing bracket; null stays (O109)."""
    return F.when(c.rlike(r"^Translation \(a\)?"), model1).when(c.rlike(r"^Translation \(b\)?"), model2).otherwise(c)


def fingerprint(*parts: Column, length: int = 5) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def language_name(code: Column) -> Column:
    """English names by code; regional codes go by their first part; unknown ones give null (O126)."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(known, F.upper(F.split(code, "-")[0]))


def language_code(code: str) -> str:
    return code.split("-")[0].upper()


def bounded(list_of_words: list[str]) -> str:
    """A pattern for any of the words between non-word characters, in any case; the same in Java and RE2 syntax."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(list_of_words) + r")($|[^\p{L}\p{N}_])"


def has_word(c: Column, list_of_words: list[str]) -> Column:
    return c.rlike("(?iu)" + bounded(list_of_words)) if list_of_words else F.lit(False)


def parse_tags(c: Column) -> Column:
    """array<struct<tag, explanation>> of a JSON list (O115). Of an unfinished one, without its last bracket, what stands between commas is
    taken without the last piece, if all of it is JSON objects; anything else gives an empty list."""
    kind = "struct<tag:string,explanation:string>"
    none = F.array().cast(f"array<{kind}>")
    pieces = F.transform(F.split(F.substring(c, 2, 1 << 30), ","), lambda x: F.trim(x))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    rest = F.when(F.forall(pieces, lambda x: F.json_object_keys(x).isNotNull()), F.transform(pieces, lambda x: F.from_json(x, kind)))
    return F.coalesce(F.when(F.endswith(c, F.lit("]")), F.from_json(c, f"array<{kind}>")).otherwise(rest), none)


def tag_names(tags: Column) -> Column:
    return F.transform(F.filter(tags, lambda t: t["tag"].isNotNull()), lambda t: t["tag"])


def expected_score(logprobs: list[Column], missing: float = -20.0, default: float = 3.0) -> Column:
    """Mean of the scores 1, 2, ... under the softmax of their log probabilities (O114); ``default`` where it is no number."""
    values = [F.coalesce(x.cast("double"), F.lit(missing)) for x in logprobs]
    top = F.greatest(*values)
    weights = [F.exp(v - top) for v in values]
    total = reduce(lambda a, b: a + b, weights)
    mean = reduce(lambda a, b: a + b, [w * float(k) for k, w in enumerate(weights, 1)]) / total
    return F.when(F.isnan(mean), default).otherwise(F.coalesce(mean, F.lit(default)))


def char_cost(chars: Column, per_euro: int = 50_000) -> Column:
    return chars / F.lit(per_euro)
