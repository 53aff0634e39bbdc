"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only.

Kinds, in order: email, ip, card, phone (the base; a confirmed match always stays), then iban, ssn, tel, which the
method adds: an iban if its remainder by 97 is 1, an ssn or a phone number without + if words nearby lift its score to ENOUGH.
Null texts count as empty. Rows are never joined or grouped: repeated rows, null ids and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import named, unused
from quarry.llm.spans import SPAN, with_matches

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn", "tel"]

#: Possessive forms of the plain patterns; \G or a look behind lets a match start only where a longer one cannot, so that time is linear.
#: iban matches the first four characters alone and looks ahead for the rest, so that every start is tried; accounts() finds the end.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+)(.-])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: Score without and with a word of WORDS within NEAR code points.
SCORES = {"email": (0.9, 1.0), "ip": (0.7, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.9), "iban": (0.8, 1.0), "ssn": (0.3, 0.8), "tel": (0.3, 0.7)}
ENOUGH, NEAR = 0.5, 40
#: Words nearby that speak for a kind, in English, Spanish, French and German.
_PHONE = r"(?iu)\b(phone|tel|telephone|call|mobile|fax|teléfono|móvil|llame|llamar|téléphone|portable|appeler|appelez|telefon|handy|anrufen|ruf)\b"
WORDS = {
    "email": r"(?iu)\b(e-?mail|mail|contact|write|correo|escriba|courriel|écrire|schreiben|kontakt)\b",
    "ip": r"(?iu)\b(ip|address|host|server|dirección|servidor|adresse|serveur)\b",
    "card": r"(?iu)\b(card|visa|mastercard|credit|debit|pay|tarjeta|pagar|carte|payer|karte|zahlen)\b",
    "phone": _PHONE,
    "iban": r"(?iu)\b(iban|account|bank|konto|cuenta|banco|compte|banque)\b",
    "ssn": r"(?iu)\b(ssn|social security|tax id|seguro social|sécurité sociale|sozialversicherung)\b",
    "tel": _PHONE,
}


def luhn(text: Column) -> Column:
    """Whether the digits of a text pass Luhn's check, if there are 16 to 19."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.when(F.length(digits).between(16, 19), F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def mod97(text: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, its first four characters last and letters as 10 to 35."""
    bare = F.regexp_replace(text, " ", "")
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), "")
    value = F.transform(turned, lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.length(bare).between(15, 34) & (F.aggregate(value, F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97) == 1)


#: Characters of an account number by country, as registered.
LENGTHS = {
    country: int(n)
    for n, countries in (
        x.split(":")
        for x in """15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA
        23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM
        28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU""".split()
    )
    for country in countries.split(",")
}


def accounts(heads: Column, rests: Column) -> Column:
    """Account numbers by their first four characters and the run that follows each of these.

    A run may go on into the next words, so every part of it that ends at a space or with the run is tried. Of several that
    pass, the one as long as its country's numbers are is taken, else the longest. Numbers from different starts may overlap.
    """
    lengths = F.create_map(*(F.lit(x) for pair in LENGTHS.items() for x in pair))

    def account(s: Column, rest: Column) -> Column:
        words = F.split(F.concat(s["text"], rest), " ")
        good = F.filter(F.transform(words, lambda _, i: F.array_join(F.slice(words, F.lit(1), i + 1), " ")), mod97)
        fit = F.filter(good, lambda x: F.length(F.regexp_replace(x, " ", "")) == F.try_element_at(lengths, F.substring(x, 1, 2)))
        best = F.coalesce(F.try_element_at(fit, F.lit(-1)), F.try_element_at(good, F.lit(-1)))
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(best)).alias("end"), best.alias("text"))

    return F.filter(F.zip_with(heads, rests, account), lambda s: s["text"].isNotNull())


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

CONFIRM = {
    "ip": lambda x: x.rlike(rf"\A{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z"),
    "card": luhn,
    "phone": lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(8, 15),
    "ssn": lambda x: ~x.rlike(r"\A(?:000|666|9)|-00-|0000\z"),
}


def find(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The rows with a column `spans`: array<struct<kind, start, end, score>> by kind as listed, then start.

    A column of that name is replaced; other columns stay as they are.
    """
    kept = [c for c in docs.columns if c.lower() != spans.lower()]
    df = docs.select(F.struct(*map(named, kept)).alias("row"), F.coalesce(named(text), F.lit("")).alias("t"))
    digit = F.col("t").rlike("[0-9]")
    df = with_matches(df, "t", PATTERNS, {"email": F.instr("t", "@") > 0, "phone": F.instr("t", "+") > 0, "ip": digit, "card": digit, "ssn": digit, "tel": digit, "iban": digit})

    def scored(kind: str) -> Column:
        some = F.col(kind)
        if kind == "iban":
            some = F.when(F.size(some) > 0, accounts(some, F.regexp_extract_all("t", F.lit(PATTERNS[kind]), F.lit(1)))).otherwise(F.array().cast(SPAN))
        if kind in CONFIRM:
            some = F.filter(some, lambda s: CONFIRM[kind](s["text"]))
        if kind == "tel":
            some = F.filter(some, lambda s: ~F.exists(F.col("phone"), lambda p: (p["start"] < s["end"]) & (s["start"] < p["end"])))
        low, high = SCORES[kind]

        def score(s: Column) -> Column:
            at = F.greatest(s["start"] - NEAR, F.lit(0))
            around = F.concat(F.substr(F.col("t"), at + 1, s["start"] - at), F.lit("\n"), F.substr(F.col("t"), s["end"] + 1, F.lit(NEAR)))
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.when(around.rlike(WORDS[kind]), high).otherwise(low).alias("score"))

        out = F.transform(some, score)
        return out if kind in BASE else F.filter(out, lambda s: s["score"] >= ENOUGH)

    return df.select("row", F.concat(*(scored(k) for k in KINDS)).alias("spans")).select(*(F.col("row")[c].alias(c) for c in kept), F.col("spans").alias(spans))


def redact(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Each run of overlapping spans in `text` becomes the name of its first kind in brackets, such as [EMAIL].

    Of spans that start together the longest names the run. Rows without spans, and null texts, stay as they are.
    """
    item = "array<struct<start:int,end:int,kind:string>>"
    ordered = F.array_sort(F.transform(named(spans), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def join(done: Column, s: Column) -> Column:
        last, end = F.element_at(done, -1), -s["end"]
        own = F.array(F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind")))
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["kind"].alias("kind")))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), wider)).otherwise(F.concat(done, own))

    runs = F.when(F.size(named(spans)) > 0, F.aggregate(ordered, F.array().cast(item), join)).otherwise(F.array().cast(item))
    held, columns = unused(found, "runs"), found.columns
    df = found.select(*map(named, columns), runs.alias(held))
    t, r = named(text), F.col(held)

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(r, F.greatest(i, F.lit(1)))["end"]).otherwise(0)
        return F.concat(F.substr(t, before + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    whole = F.concat(F.array_join(F.transform(r, piece), ""), F.substr(t, F.element_at(r, -1)["end"] + 1))
    masked = F.when(F.size(r) > 0, whole).otherwise(t).alias(text)
    return df.select(*(masked if c == text else named(c) for c in columns))
