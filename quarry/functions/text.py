"""Words of a text: lower case, punctuation apart, letters only, no stop words, stems."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = ".,;:¡!¿?"
#: Common Spanish words that say little (fixed values).
STOP_WORDS = tuple(
    """a al algo ante como con cual cuando de del desde donde el ella ellas ellos en entre era es esa ese eso esta este esto fue ha
    hasta hay la las le les lo los más me mi muy nada ni no nos o para pero por porque que quien se ser si sin sobre son su sus también te
    tiene todo tu un una uno y ya yo""".split()
)


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS, stems: bool = False) -> Column:
    """The words of a text that consist of letters alone, as an array; a null text has none."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([.,;:¡!¿?])", " $1 ")
    words = F.regexp_extract_all(apart, F.lit(r"(?<!\S)\p{L}++(?!\S)"), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    return stem_all(words) if stems else words


VOWELS = "aeiouáéíóúü"
_PLAIN = str.maketrans("áéíóú", "aeiou")

#: Suffixes of the published Spanish stemming algorithm, by step (fixed values).
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
GERUNDS = "iéndo ándo ár ér ír ando iendo ar er ir".split()
S1_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
S1_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
S1_REPLACE = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
S2_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
S2_GU = "en es éis emos".split()
S2_DELETE = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá
eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran
ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais
aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()
S3_DELETE = "os a o á í ó".split()


def _regions(w: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    r1 = after(0)
    r2 = after(r1)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in VOWELS), len(w))
        elif w[0] in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in VOWELS), len(w))
        else:
            rv = 3
    return rv, r1, r2


def _longest(w: str, suffixes, start: int) -> str | None:
    """The longest suffix of w that lies in the region from start on."""
    return max((s for s in suffixes if w.endswith(s) and len(w) - len(s) >= start), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case Spanish word by the published Snowball rules."""
    w = word
    rv, r1, r2 = _regions(w)
    if (p := _longest(w, PRONOUNS, rv)) is not None:
        rest = w[: -len(p)]
        g = max((s for s in GERUNDS if rest.endswith(s) and len(rest) - len(s) >= rv), key=len, default=None)
        if g is not None:
            w = rest[: -len(g)] + g.translate(_PLAIN)
        elif rest.endswith("yendo") and len(rest) - 5 >= rv and rest[-6:-5] == "u":
            w = rest
    before = w
    every = [*S1_DELETE, *S1_IC, *S1_REPLACE, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    s = max((x for x in every if w.endswith(x)), key=len, default=None)
    cut = len(w) - len(s) if s else 0

    def drop(*endings: str) -> bool:
        nonlocal w
        for e in endings:
            if w.endswith(e) and len(w) - len(e) >= r2:
                w = w[: -len(e)]
                return True
        return False

    if s == "amente" and cut >= r1:
        w = w[:cut]
        if drop("iv"):
            drop("at")
        else:
            drop("os", "ic", "ad")
    elif s is not None and s != "amente" and cut >= r2:
        if s in S1_REPLACE:
            w = w[:cut] + S1_REPLACE[s]
        else:
            w = w[:cut]
            if s in S1_IC:
                drop("ic")
            elif s == "mente":
                drop("ante", "able", "ible")
            elif s in ("idad", "idades"):
                drop("abil", "ic", "iv")
            elif s in ("iva", "ivo", "ivas", "ivos"):
                drop("at")
    if w == before:
        y = _longest(w, S2_Y, rv)
        if y is not None and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        else:
            e = _longest(w, [*S2_GU, *S2_DELETE], rv)
            if e is not None:
                w = w[: -len(e)]
                if e in S2_GU and w.endswith("gu"):
                    w = w[:-1]
    if (e := _longest(w, S3_DELETE, rv)) is not None:
        w = w[: -len(e)]
    elif (e := _longest(w, ("e", "é"), rv)) is not None:
        w = w[: -len(e)]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)


def stem_all(words: Column) -> Column:
    """The stems of an array of words; each distinct word of a batch is stemmed once."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return batch.map(lambda ws: [known.setdefault(w, stem(w)) if w not in known else known[w] for w in ws])

    return run(words)
