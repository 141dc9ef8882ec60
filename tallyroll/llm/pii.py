"""Keyed surrogates for personal data: same type, script and format, one per entity everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Titles before names (fixed values).
_TITLES = ("Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Herr|Frau|Fräulein|Monsieur|Madame|Mme|Mlle|Señor|Señora|Señorita|Sr|Sra|Srta|Dra"
           "|Г-н|Г-жа|Κος|Κα")
#: Function words, days and months that end a name, in any case (fixed values); "will" and "may" do not, as they are names too.
_NO_NAME = (
    "the|this|that|these|those|a|and|but|or|if|when|while|who|what|where|why|how|he|she|it|we|you|they|i|his|her|their|its|our|my|your"
    "|on|in|at|to|from|for|with|by|of|as|after|before|since|until|about|is|was|are|were|has|had|have|did|does|not|yes|said|then|there|here"
    "|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|july|september|october|november|december"
    "|der|die|und|aber|im|am|um|mit|nach|bei|auf|aus|ist|war|hat|sie|wir|ihr|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag"
    "|et|mais|dans|avec|pour|sur|est|il|elle|nous|vous|ils|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche"
    "|pero|con|por|para|ella|ellos|lunes|martes|miércoles|jueves|viernes|sábado|domingo")
#: Names that are everyday words: they are replaced in a titled name, but not where they stand alone (fixed values).
_EVERYDAY = "will may mark bill rose grace hope joy art dean young long king page day april june august summer".split()
#: Lower-case words inside names, the longer ones first; they stay (fixed values).
_PARTICLES = "della|degli|dell|dalla|dos|das|dal|del|den|der|des|di|da|de|do|du|van|von|vom|zum|zur|zu|ten|ter|te|la|le|lo|el|al|bin|ibn|af|av|y|e|[dl]['’]"
#: One word of a name: inner capitals and apostrophes belong to it, a possessive or contracted ending does not.
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’](?!(?:s|S|d|m|t|ll|re|ve)(?![\p{L}\p{M}]))[\p{L}\p{M}]++)*+"
_UNIT = (r"(?:\p{Lu}\.[ -]?+){0,8}(?:(?:" + _PARTICLES + r")[ -]?+){0,8}(?!(?iu:" + _NO_NAME + r")(?![\p{L}\p{M}'’]))" + _WORD)
#: Detection patterns by type, tried in this order (fixed values; each starts at a word edge and
#: runs possessively, so a long text without matches costs linear time).
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:(?:[\p{L}\p{N}-]++\.)++\p{L}{2,}+"
             r"|[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,126}\.\p{L}{2,}+)",  # the second gives back a full stop
    "key": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"
           r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "ip6": r"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f:]{7})(?=[A-Fa-f:]{0,39}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
           r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![A-Za-z0-9:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "card": r"(?<!\d)(?:\d{4}[ -]?){3}\d{1,7}(?!\d)|(?<!\d)3\d{3}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
             r"|(?<![\d+])\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,4}+(?!\d)"
             r"|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
             r"|(?<![\d.,+-])0\d{2,4} \d{3,4} \d{3,4}(?![\d.,-])",
    "person": r"(?<!\p{L})(?:(?:" + _TITLES + r")\.? ){1,4}+(?!(?:" + _TITLES + r")(?![\p{L}\p{M}]))" + _UNIT
              + r"(?:[ -](?!(?:" + _TITLES + r")(?![\p{L}\p{M}]))" + _UNIT + ")*+",
}
_BY_DIGIT = ("ip", "ssn", "card", "phone")
#: One pass for all, with the matches of the plain union: numbers are tried at a digit, plus or bracket only;
#: the rest never stands after an ASCII letter, and each pattern asks for its own left edge.
ANY = (
    r"(?<![A-Za-z])(?=[\p{L}\p{N}._%+-])(?:" + "|".join(f"(?:{p})" for n, p in PATTERNS.items() if n not in _BY_DIGIT)
    + r")|(?=[0-9+(])(?:" + "|".join(f"(?:{PATTERNS[n]})" for n in _BY_DIGIT) + ")"
)
#: What every match has: a digit, an at sign, the prefix of a key or token, 32 letters of a hexadecimal number, or a title.
#: Quick to test for texts without any.
_SIGN = r"[0-9@]|AKIA|ASIA|gh[pousr]_|sk-|eyJ|[a-f]{32}"
_TITLED = "(?=[" + "".join(sorted({t[0] for t in _TITLES.split("|")})) + "])(?:" + _TITLES + r")\.? \p{L}"
#: Titles of women (fixed values); the other titles are men's.
_FEMALE = r"^(?:(?:Dr|Prof|Professor)\.? )*(?:Mrs|Ms|Miss|Frau|Fräulein|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Dra|Г-жа|Κα)(?!\p{L})"
_TITLE = r"^(?:(?:" + _TITLES + r")\.? )+"
#: Syllables for names by script, and the endings of women's and men's names (fixed values).
_SYLLABLES = {
    "latin": ("ba da fa ga la ma na ra sa ta be de le me ne re se te bi di li mi ni ri si ti bo do lo mo no ro", "a", "n"),
    "cyrillic": ("ба да га ла ма на ра са та ва бе де ле ме не ре се те би ди ли ми ни ри си ти бо до ло мо но ро", "а", "н"),
    "greek": ("βα δα γα λα μα να ρα σα τα πα βε δε λε με νε ρε σε τε βι δι λι μι νι ρι σι τι βο δο λο μο νο ρο", "α", "ς"),
}


def entity_type(value: Column) -> Column:
    """First type whose pattern fits the whole value."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def may_have(text: Column) -> Column:
    """True for every text with a match of ANY, and for some without."""
    return text.rlike(_SIGN) | text.rlike(_TITLED)


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def _capitals(word: Column) -> Column:
    return (F.length(word) > 1) & (word == F.upper(word))


def _mention(text: Column) -> Column:
    """The pattern of all mentions in a text: ANY, and the words of its titled names wherever they recur.

    Words recur as they are, in capitals, or with one capital. Single letters and everyday words are no names of their own.
    """
    titled = F.filter(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: v.rlike(f"^{PATTERNS['person']}$"))
    words = F.flatten(F.transform(titled, lambda v: F.regexp_extract_all(F.regexp_replace(v, _TITLE, ""), F.lit(_WORD), F.lit(0))))
    words = F.filter(F.array_distinct(words), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(_EVERYDAY))
    forms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), _capitalised(w)))))
    again = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(F.sort_array(forms, asc=False), "|"),
                     F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    return F.when(text.rlike(_TITLED) & (F.size(forms) > 0), again).otherwise(F.lit(ANY))


def canonical(kind: Column, value: Column) -> Column:
    """What makes two mentions one entity: digits of numbers, lower case of addresses, a capital and lower case of names."""
    return (F.when(kind.isin("phone", "card", "ssn"), _digits(value))
            .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
            .when(kind.isin("email", "ip6"), F.lower(value)).when(kind == "person", _capitalised(value)).otherwise(value))


def _noise(seed: Column, i: Column, n: int) -> Column:
    """Keyed number below ``n`` (up to 4096) for place ``i``."""
    place = (i % 40) * 3 + 1
    return F.pmod(F.conv(F.substring(seed, place, F.lit(3)), 16, 10).cast("int") + F.floor(i / 40).cast("int") * 7, F.lit(n))


def _pick(choices: list[str], seed: Column):
    return lambda i: F.get(F.array(*[F.lit(x) for x in choices]), _noise(seed, i, len(choices)))


_LETTERS = {
    r"^[0-9]$": "0123456789", r"^[a-z]$": "abcdefghijklmnopqrstuvwxyz", r"^[A-Z]$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"^\p{IsCyrillic}$": "абвгдежзиклмнопрстуфхцчшя", r"^\p{IsGreek}$": "αβγδεζηθικλμνξοπρστυφχψω", r"^\p{L}$": "aeioubcdfghlmnprst",
}


def _alike(text: Column, seed: Column) -> Column:
    """Every letter and digit replaced by one of its script, case and kind."""
    def one(ch: Column, i: Column) -> Column:
        out = ch
        for pattern, alphabet in reversed(_LETTERS.items()):
            out = F.when(ch.rlike(pattern), F.substring(F.lit(alphabet), _noise(seed, i, len(alphabet)) + 1, F.lit(1))).otherwise(out)
        return out
    return F.array_join(F.transform(F.split(text, ""), one), "")


def is_card(value: Column) -> Column:
    """True for a number that passes the card checksum."""
    digits = _digits(value)
    return digits == _with_check_digit(digits)


def _with_check_digit(digits: Column) -> Column:
    """The last digit replaced so that the number passes the card checksum."""
    n = F.length(digits)
    body = F.split(F.substring(digits, F.lit(1), n - 1), "")
    weighed = F.transform(body, lambda d, i: (
        F.when((n - 1 - i) % 2 == 1, F.floor(d.cast("int") * 2 / 10) + d.cast("int") * 2 % 10).otherwise(d.cast("int"))).cast("int"))
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(digits, F.lit(1), n - 1), F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def seed_of(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)


def surrogate(kind: Column, canon: Column, female: Column, attempt: Column, seed: Column) -> Column:
    """Replacement of a canonical entity; another one for each seed."""
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    labels = F.slice(F.split(domain, r"\."), 1, F.size(F.split(domain, r"\.")) - 1)
    hosts = F.transform(labels, lambda x, i: F.when(x == "example", x).otherwise(_alike(x, F.sha2(F.concat(seed, i.cast("string")).cast("binary"), 512))))
    email = F.concat(_alike(local, seed), F.lit("@"), F.array_join(hosts, "."), F.lit("."), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_noise(seed, i, 254) + 1).cast("string")), ".")
    card = _with_check_digit(F.concat(F.substring(canon, 1, 1), _alike(F.substring(canon, F.lit(2), F.length(canon)), seed)))
    prefix = F.regexp_extract(canon, r"^(AKIA|ASIA|gh[pousr]_|sk-|eyJ|[A-Z]{2}(?=\d))", 1)
    groups = F.array_join(F.zip_with(F.split(canon, ""), F.split(F.substring(seed, F.lit(1), F.length(canon)), ""),
                                     lambda a, b: F.when(a == ":", a).otherwise(b)), "")
    prefixed = F.concat(prefix, _alike(F.substring(canon, F.length(prefix) + 1, F.length(canon)), seed))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    person = F.lit(None).cast("string")
    count = F.greatest(F.lit(2), F.floor(F.length(canon) / 2).cast("int")) + F.floor(attempt / 4).cast("int")
    for name, (syllables, woman, man) in _SYLLABLES.items():
        made = F.array_join(F.transform(F.sequence(F.lit(1), count), _pick(syllables.split(), seed)), "")
        person = F.when(script == name, F.concat(F.initcap(made), F.when(female, woman).otherwise(man))).otherwise(person)
    hexadecimal = F.substring(seed, F.lit(1), F.length(canon))
    return (F.when(kind == "email", email).when(kind == "hex", hexadecimal).when(kind == "ip", ip).when(kind == "ip6", groups).when(kind == "card", card)
            .when(kind.isin("key", "iban"), prefixed).when(kind == "person", person).otherwise(_alike(canon, seed)))


def formatted(kind: Column, value: Column, replacement: Column) -> Column:
    """The canonical replacement in the format of this mention: separators, country code, case."""
    def refill(pattern: str, kept: Column) -> Column:
        chars = F.split(value, "")
        at = F.transform(chars, lambda ch, i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), pattern, "")))
        return F.array_join(F.zip_with(chars, at, lambda ch, n: F.when(
            ch.rlike(pattern) | (n <= kept), ch).otherwise(F.substring(replacement, n, F.lit(1)))), "")
    country = F.length(F.regexp_extract(value, r"^\+(\d{1,3})(?=[ .(-])", 1))
    cased = F.array_join(F.zip_with(F.split(value, ""), F.split(replacement, ""), lambda a, b: F.when(
        a != F.lower(a), F.upper(b)).otherwise(b)), "")
    return (F.when(kind == "phone", refill(r"\D", country)).when(kind.isin("card", "ssn"), refill(r"\D", F.lit(0)))
            .when(kind == "iban", refill(" ", F.lit(0)))
            .when((kind == "person") & _capitals(value), F.upper(replacement))
            .when((kind == "ip6") & (value != F.lower(value)), F.upper(replacement))
            .when((kind == "email") & (F.length(value) == F.length(replacement)), cased).otherwise(replacement))


def assign(entities: DataFrame, key: str, most_attempts: int = 64) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities, no two of a kind alike and none an entity itself.

    Entities whose replacement is another's (all but the first by value) or is itself
    an entity of the corpus try again, with written tables between attempts.
    """
    def tried(df: DataFrame) -> DataFrame:
        seeded = df.withColumn("seed", seed_of(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        return seeded.withColumn("surrogate", surrogate(*map(F.col, ("kind", "canon", "female", "attempt", "seed")))).drop("seed")

    now = written(tried(entities.withColumn("attempt", F.lit(0))), "surrogates")
    for _ in range(most_attempts):
        first = now.groupBy("kind", "surrogate").agg(F.min("canon").alias("owner"), F.count("*").alias("c"))
        taken = now.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
        clash = first.join(taken, ["kind", "surrogate"], "left").filter("c > 1 or taken")
        again = written(now.join(clash, ["kind", "surrogate"]).filter("taken or canon <> owner").select(
            "kind", "canon"), "surrogate-clashes")
        if again.isEmpty():
            return now.select("kind", "canon", "surrogate")
        kept = now.join(again, ["kind", "canon"], "left_anti")
        moved = now.join(again, ["kind", "canon"], "left_semi").drop("surrogate").withColumn("attempt", F.col("attempt") + 1)
        now = written(kept.unionByName(tried(moved)), "surrogates")
    raise RuntimeError(f"no distinct surrogates after {most_attempts} attempts")


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its text's entities replaced, and ``pii_types``, the types in order of place.

    All columns of ``docs`` stay, but for an earlier ``pii_types``. An entity (same type and canonical form) has one
    surrogate in the whole corpus under one key; different entities have different
    ones. Numbers keep separators, country code and (cards) a valid checksum, keys
    their prefix, addresses their top-level domain and case, names their script and
    the gender of the title; each word of a name is replaced for itself, so a surname
    alone refers to the same person. A name is the whole run of capitalised words after
    a title, up to a function word, day or month; its words are replaced wherever they recur
    in the text, with a title or without, but for everyday words (Will, May) that stand alone. Particles, titles and
    possessive endings stay. A card-shaped number that fails the card checksum is none and stays.

    Texts without entities are not touched or shuffled. Null texts stay null, empty
    ones empty, with no types. Repeated rows are replaced alike. An empty table gives
    no rows. A frequent entity is one row of the surrogate table; its mentions are the
    skewed side of one join, which adaptive execution splits.
    """
    docs, text = docs.drop("pii_types"), F.col(text_col)
    names = docs.columns
    has = F.coalesce(may_have(text) & text.rlike(ANY), F.lit(False))
    ids = [F.xxhash64(id_col, text_col).alias("_pii_a"), F.hash(id_col, text_col).alias("_pii_b")]
    dirty = docs.filter(has).withColumn("_pii_mention", _mention(text))
    found = dirty.select(*ids, F.posexplode(F.regexp_extract_all(text, F.col("_pii_mention"), F.lit(0))).alias("i", "value"))
    found = found.withColumn("kind", F.coalesce(entity_type(F.col("value")), F.lit("person")))  # a name that recurs fits no type
    found = found.withColumn("kind", F.when((F.col("kind") != "card") | is_card(F.col("value")), F.col("kind")))  # null: stays as it is
    is_person = F.col("kind") == "person"
    rest = F.regexp_replace("value", _TITLE, "")
    words = F.when(is_person, F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0))).otherwise(F.array("value"))
    mentions = found.withColumn("female", is_person & F.col("value").rlike(_FEMALE)).select(
        "_pii_a", "_pii_b", "i", "value", "kind", "female", F.posexplode(words).alias("j", "word")).withColumn(
        "canon", canonical(F.col("kind"), F.col("word")))
    mentions = written(mentions, "mentions")
    entities = mentions.filter("kind is not null").groupBy("kind", "canon").agg(F.max("female").alias("female"))
    known = assign(entities, key)
    replaced = mentions.join(known, ["kind", "canon"], "left").withColumn(
        "new", F.coalesce(formatted(F.col("kind"), F.col("word"), F.col("surrogate")), F.col("word")))
    whole = replaced.groupBy("_pii_a", "_pii_b", "i", "kind", "value").agg(
        F.sort_array(F.collect_set(F.struct("j", "new"))).alias("w")).withColumn("w", F.col("w.new"))
    title = F.regexp_extract("value", _TITLE, 0)
    gaps = F.split(rest, _WORD, -1)
    joined = F.concat(title, F.array_join(F.zip_with(gaps, "w", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    whole = whole.withColumn("new", F.when(F.col("kind") == "person", joined).otherwise(F.get("w", F.lit(0))))
    per_text = whole.groupBy("_pii_a", "_pii_b").agg(F.sort_array(F.collect_list(F.struct("i", "new", "kind"))).alias("_pii_new"))
    parts = F.split(text, F.col("_pii_mention"), -1)
    filled = F.array_join(F.zip_with(parts, F.col("_pii_new.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = dirty.withColumns(dict(zip(("_pii_a", "_pii_b"), ids, strict=True))).join(
        per_text, ["_pii_a", "_pii_b"]).select(
        *[filled.alias(c) if c == text_col else F.col(c) for c in names], F.filter("_pii_new.kind", lambda k: k.isNotNull()).alias("pii_types"))
    clean = docs.filter(~has).withColumn("pii_types", F.array().cast("array<string>"))
    return clean.union(changed)
