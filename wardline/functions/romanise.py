"""Malayalam script to lower-case Latin letters, driven by a character table.

A consonant carries an inherent ``a`` unless a vowel sign or the virama
follows.  The table follows public transliteration charts (one Latin spelling
per sign, case folded) and can be replaced by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin spelling of the Malayalam signs.
CONSONANTS = {
    "ക": "k", "ഖ": "kh", "ഗ": "g", "ഘ": "gh", "ങ": "~n",
    "ച": "ch", "ഛ": "ch", "ജ": "j", "ഝ": "jh", "ഞ": "~n",
    "ട": "t", "ഠ": "th", "ഡ": "d", "ഢ": "dh", "ണ": "n",
    "ത": "t", "ഥ": "th", "ദ": "d", "ധ": "dh", "ന": "n",
    "പ": "p", "ഫ": "ph", "ബ": "b", "ഭ": "bh", "മ": "m",
    "യ": "y", "ര": "r", "റ": "r", "ല": "l", "ള": "l", "ഴ": "zh", "വ": "v",
    "ശ": "sh", "ഷ": "sh", "സ": "s", "ഹ": "h",
}
VOWELS = {
    "അ": "a", "ആ": "a", "ഇ": "i", "ഈ": "i", "ഉ": "u", "ഊ": "u", "ഋ": "r",
    "എ": "e", "ഏ": "e", "ഐ": "ai", "ഒ": "o", "ഓ": "o", "ഔ": "au",
}
VOWEL_SIGNS = {
    "ാ": "a", "ി": "i", "ീ": "i", "ു": "u", "ൂ": "u", "ൃ": "r",
    "െ": "e", "േ": "e", "ൈ": "ai", "ൊ": "o", "ോ": "o", "ൌ": "au", "ൗ": "au",
}
OTHERS = {
    "ം": "m", "ഃ": "h", "ൻ": "n", "ർ": "r", "ൽ": "l", "ൾ": "l", "ൺ": "n", "ൿ": "k",
    "൦": "0", "൧": "1", "൨": "2", "൩": "3", "൪": "4", "൫": "5", "൬": "6", "൭": "7", "൮": "8", "൯": "9",
}
VIRAMA = "്"

CHAR_MAP = {**CONSONANTS, **VOWELS, **VOWEL_SIGNS, **OTHERS, VIRAMA: ""}
SCRIPT = r"[\x{d00}-\x{d7f}]"


def romanise(c: Column, char_map: dict[str, str] = CHAR_MAP) -> Column:
    """Texts without the script are passed through untouched."""
    consonants = "".join(k for k in CONSONANTS if k in char_map)
    silent = "".join(VOWEL_SIGNS) + VIRAMA
    spelled = F.regexp_replace(c, f"([{consonants}])(?![{silent}])", "$1a")
    # one-to-one signs by a single pass of translate, the rest one by one
    single = {k: v for k, v in char_map.items() if len(v) <= 1}
    ordered = sorted(single, key=lambda k: single[k] == "")
    spelled = F.translate(spelled, "".join(ordered), "".join(single[k] for k in ordered))
    for char, latin in char_map.items():
        if len(latin) > 1:
            spelled = F.replace(spelled, F.lit(char), F.lit(latin))
    return F.when(c.rlike(SCRIPT), spelled).otherwise(c)
