"""Text normalisers built from native string expressions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, functions as F

# The symbol sets results depend on.
VALUE_SYMBOLS = "#%^&*!@()-=/.:;,\\"
STAGING_SYMBOLS = "#%^&*!@()[]=.:;\\+'\""
LABEL_SYMBOLS = "%*@!$^+,:\"><&[()]';_="
LABEL_DELETED = "#"
DIGITS = "0123456789"

# Abbreviation -> expansion.
ABBREVIATIONS = {
    "INV": "Invasive",
    "Inv": "Invasive",
    "AvDO2": "avdo2",
    "FiO2": "fio2",
    "CaO2": "cao2",
    "s/p": "status post",
    "S/P": "status post",
    "D/C": "discontinue",
    "RLQ": "Right Lower Quadrant of Abdomen",
    "RUQ": "Right Upper Quadrant of Abdomen",
    "LLQ": "Left Lower Quadrant of Abdomen",
    "LUQ": "Left Upper Quadrant of Abdomen",
    "RUE": "Right Upper Extremity",
    "RLE": "Right Lower Extremity",
    "PO": "by mouth",
    "po": "by mouth",
    "airleak": "air leak",
    "mlns": "ml normal saline solution",
    "NS": "normal saline solution",
    "NSS": "normal saline solution",
    "nss": "normal saline solution",
    "ns": "normal saline solution",
    "02sat": "oxygen saturation",
    "sat02": "oxygen saturation",
    "satO2": "oxygen saturation",
    "O2sat": "oxygen saturation",
    "LDH": "Lactate dehydrogenase enzyme",
    "art": "arterial",
    "ART": "arterial",
    "bp": "blood pressure",
    "BP": "Blood Pressure",
    "angio": "angiography",
    "NeoSure": "neosure",
    "NeoCate": "neocate",
    "PRBCS": "Packed Red Blood Cells",
    "PRBCs": "Packed Red Blood Cells",
    "PRBC'S": "Packed Red Blood Cells",
    "PRBC": "Packed Red Blood Cells",
    "prbc": "Packed Red Blood Cells",
    "BNP": "Brain natiuretic Peptide",
    "High PIP": "High Peak Inspiratory Pressure",
    "PIP": "Peak Inspiratory Pressure",
    "high pip": "high peak inspiratory pressure",
    "trach": "tracheal",
    "Trach": "tracheal",
    "baedp": "balloon aortic end-diastolic pressure",
    "kvo": "keep vein open",
    "KVO": "Keep Vein Open",
    "PTT": "Partial Thromboplastin Time",
    "ed": "emergency department",
    "LR": "lactated Ringer's solution",
    "lr": "lactated Ringer's solution",
    "(L)": "(Left)",
    "(R)": "(Right)",
    "Neg": "negative",
    "Insp": "Inspiratory",
    "Insp.": "Inspiratory",
    "LCW": "Left Cardiac Work",
    "LCWI": "Left Cardiac Work Index",
    "LVSW": "Left Ventricular Stroke Work",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def symbols_to_space(c: Column | str, symbols: str, deleted: str = "") -> Column:
    """Each symbol becomes a space; ``deleted`` characters vanish."""
    return F.translate(_col(c), symbols + deleted, " " * len(symbols))


def normalise_value(value: Column | str, squeeze: bool = False) -> Column:
    """Free-text event value without digits and symbols; null when blank.

    Inner spaces stay as they fall unless ``squeeze``.
    """
    text = F.lower(symbols_to_space(_col(value).cast("string"), VALUE_SYMBOLS, DIGITS))
    if squeeze:
        text = F.trim(F.regexp_replace(text, " +", " "))
    return F.when(F.btrim(text, F.lit(" ")) != "", text)


def staging_text(c: Column | str) -> Column:
    return symbols_to_space(c, STAGING_SYMBOLS)


def description_tokens(label: Column | str) -> Column:
    """Lower-cased pieces between spaces, commas and semicolons."""
    text = F.coalesce(F.lower(_col(label).cast("string")), F.lit("N/A"))
    return F.filter(F.split(text, "[ ,;]"), lambda t: t != "")


def tokenised_description(label: Column | str) -> Column:
    return F.array_join(description_tokens(label), " ")


def _matching_spellings(key: str) -> list[str]:
    """Token spellings that equal ``key`` once word-initial a-z is upper-cased.

    A key with a lower-case word-initial letter, or with a space, can never
    be met by a single capitalised token and has none.
    """
    if " " in key:
        return []
    choices = []
    for i, ch in enumerate(key):
        starts_word = i == 0 or not (key[i - 1].isalnum() or key[i - 1] == "_")
        if starts_word and ch.isascii() and ch.islower():
            return []
        if starts_word and ch.isascii() and ch.isupper():
            choices.append((ch, ch.lower()))
        else:
            choices.append((ch,))
    return ["".join(letters) for letters in product(*choices)]


def abbreviation_lookup(
    table: dict[str, str] = ABBREVIATIONS, ignore_case: bool = False
) -> dict[str, str]:
    """Token -> expansion as the capitalise-then-look-up rule sees it."""
    if ignore_case:
        return {k.lower(): v for k, v in table.items() if " " not in k}
    return {s: v for k, v in table.items() for s in _matching_spellings(k)}


def clean_label(
    label: Column | str,
    table: dict[str, str] = ABBREVIATIONS,
    ignore_case: bool = False,
) -> Column:
    """Expand abbreviations token by token, blank the symbols, lower-case.

    Null and empty labels give null, so callers can drop them.
    """
    label = _col(label)
    lookup = abbreviation_lookup(table, ignore_case)
    by_length: dict[int, list[Column]] = {}
    for key, value in lookup.items():
        by_length.setdefault(len(key), []).extend([F.lit(key), F.lit(value)])

    def expand(token: Column) -> Column:
        # a literal map is searched key by key: only try keys of this length
        key = F.lower(token) if ignore_case else token
        found = F.lit(None).cast("string")
        for length, pairs in by_length.items():
            found = F.when(F.length(token) == length, F.create_map(*pairs)[key]).otherwise(found)
        return F.coalesce(found, token)

    # most labels hold no abbreviation: one hashed test spares them the rest
    keys = F.array(*[F.lit(k) for k in lookup])
    sought = F.split(F.lower(label) if ignore_case else label, " ")
    expanded = F.when(
        F.arrays_overlap(sought, keys),
        F.array_join(F.transform(F.split(label, " "), expand), " "),
    ).otherwise(label)
    cleaned = F.lower(symbols_to_space(expanded, LABEL_SYMBOLS, LABEL_DELETED))
    return F.when(label != "", cleaned)


def acronyms(label: Column | str) -> Column:
    """Tokens made only of upper-case letters (the empty token included)."""
    return F.filter(
        F.split(_col(label), " "),
        lambda t: F.length(F.regexp_replace(t, r"\p{Lu}", "")) == 0,
    )


def words(text: Column | str, min_length: int = 1) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    pattern = r"[\p{L}\p{N}_]{%d,}" % min_length
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), F.lit(0))


def whitespace_tokens(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), r"[ \t\n\r\x0b\f]+"), lambda t: t != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column, base: Column) -> Column:
    """Exclusive running sum of an integer array, counted from ``base``."""
    zero = F.struct(base.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        lengths,
        zero,
        lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")
        ),
        lambda acc: acc["out"],
    )


def _blocked_starts(lengths: Column, base: Column, block: int) -> Column:
    """``_starts`` over blocks first and inside each block then.

    Appending copies the array built so far; short blocks keep that small.
    """

    def cut(all_lengths: Column) -> Column:
        n_blocks = F.ceil(F.size(all_lengths) / block).cast("int")
        return F.transform(
            F.filter(F.sequence(F.lit(0), n_blocks), lambda b: b < n_blocks),
            lambda b: F.slice(all_lengths, b * block + 1, F.lit(block)),
        )

    def place(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, n: x + n))
        return F.flatten(F.zip_with(blocks, _starts(sums, base), _starts))

    return let(let(lengths, cut), place)


def located_words(text: Column | str, block: int = 64, lower: bool = False) -> Column:
    """Array of (word, begin, end): words with 0-based character offsets.

    Words and the gaps between them alternate, so a word begins where the
    lengths of the words and gaps before it add up to.
    """
    text = _col(text)
    found = F.struct(
        F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("words"),
        F.regexp_extract_all(text, F.lit(r"[^\p{L}\p{N}_]+"), F.lit(0)).alias("gaps"),
        text.rlike(r"^[^\p{L}\p{N}_]").alias("indented"),
    )

    def locate(a: Column) -> Column:
        indent = F.when(a["indented"], F.length(F.get(a["gaps"], F.lit(0)))).otherwise(0)
        after = F.when(
            a["indented"], F.slice(a["gaps"], F.lit(2), F.size(a["gaps"]))
        ).otherwise(a["gaps"])
        steps = F.zip_with(
            a["words"],
            after,
            lambda w, g: F.coalesce(F.length(w), F.lit(0)) + F.coalesce(F.length(g), F.lit(0)),
        )
        return F.zip_with(
            a["words"],
            _blocked_starts(steps, indent, block),
            lambda w, at: F.struct(
                (F.lower(w) if lower else w).alias("word"),
                at.alias("begin"),
                (at + F.length(w)).alias("end"),
            ),
        )

    return F.filter(let(found, locate), lambda s: s["word"].isNotNull())
