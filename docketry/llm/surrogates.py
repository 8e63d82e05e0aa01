"""Surrogates for personal data, in DataFrame functions only.

One pattern finds the entities; each is replaced where it stands, so no text is moved. Digits go through a keyed Feistel
permutation of all digit strings of their length: the replacement has the same form and different numbers stay different.
Names and words become keyed syllables of the same script, letter case and gender. The same entity has the same
replacement everywhere, and a name that a document gives in full is replaced where the document later uses a part of it.
A collision check over the distinct entities of all documents proves before any text is written that different entities keep
different replacements and that none is left as it was; the few that fail it, and they alone, get a further number in their
key until none does.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, plain

#: Given names by script and gender, for detection and replacement.
GIVEN = {
    ("latin", "f"): "Alice Anna Carla Carmen Claire Elena Emma Eva Julia Laura Lucia Maria Marie Mary Petra Sarah Sofia Susan Ursula Yvonne".split(),
    ("latin", "m"): "Andreas Antoine Carlos David Hans James Jean John Juan Karl Luis Mark Michael Miguel Paul Peter Pierre Robert Thomas Wolfgang".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Михаил Николай Сергей".split(),
}
#: Forms of address.
TITLES = "Mrs Mr Ms Miss Dr Prof Herr Frau Señora Señor Madame Monsieur Mme".split()
#: Sixty-four syllables a script.
SYLLABLES = {
    "latin": [c + v for c in "bdfghjklmnprstvz" for v in "aeio"],
    "cyrillic": [c + v for c in "бвгджзклмнпрстфх" for v in "аеио"],
}
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_NAMES = {
    "latin": f"[{_UP}][{_LOW}]++(?:[-'’][{_UP}][{_LOW}]++)?",
    "cyrillic": "[А-ЯЁ][а-яё]++(?:-[А-ЯЁ][а-яё]++)?",
}
_KNOWN = {s: "(?:" + "|".join(n for (k, _), names in GIVEN.items() if k == s for n in names) + ")" for s in SYLLABLES}
_TITLED = f"(?:{'|'.join(TITLES)})"

#: Kind and pattern; the first that matches at a place wins. Bounded or possessive repeats, so long texts need no stack.
PATTERNS = {
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|secret|token|api_key|apikey)\b\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}+",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d.])(?:\+\d{1,3}[ .-]?)?\d{3}[ .-]\d{3,4}[ .-]\d{4}(?!\d)|(?<![\d.+])\+\d{8,15}(?!\d)",
    "titled": rf"(?<![{_UP}{_LOW}])(?=[A-Z]){_TITLED}\b\.? {_NAMES['latin']}",
    "person_latin": rf"(?<![{_UP}{_LOW}])(?=[A-Z]){_KNOWN['latin']} {_NAMES['latin']}",
    "person_cyrillic": rf"(?<![А-яёЁ])(?=[А-Я]){_KNOWN['cyrillic']} {_NAMES['cyrillic']}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text with an entity must have somewhere.
HINT = rf"[@=:]|\d{{2}}|AKIA|(?=[A-Z])(?:{_TITLED}\b|{_KNOWN['latin']} )|(?=[А-Я]){_KNOWN['cyrillic']} "


def kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _keyed(key: str, *parts) -> Column:
    """64 hex digits that depend on the key and the parts."""
    texts = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("\u001f", F.lit(key), *texts).cast("binary"), 256)


def _number(key: str, *parts) -> Column:
    return F.conv(F.substring(_keyed(key, *parts), 1, 15), 16, 10).cast("decimal(38,0)")


def _feistel(start: Column, key: str, size: Column, width, modulus) -> Column:
    """Six rounds over a struct (left, right) of texts: the left half moves by a keyed number that the right half gives,
    then the halves change places. ``width`` and ``modulus`` give a half's length and number of values."""

    def turn(state: Column, i: Column) -> Column:
        left, right = state["left"], state["right"]
        value = F.coalesce(left.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
        moved = ((value + _number(key, i.cast("string"), size, right)) % modulus(left)).cast("decimal(38,0)").cast("string")
        return F.struct(right.alias("left"), F.lpad(moved, width(left), F.lit("0")).alias("right"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(6)]), start, turn)


def _permuted(digits: Column, key: str) -> Column:
    """Keyed permutation of the digit strings of one length (up to 36)."""
    a = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), a).alias("left"), F.substring(digits, a + 1, F.length(digits)).alias("right"))
    done = _feistel(start, key, F.length(digits).cast("string"), F.length,
                    lambda half: F.rpad(F.lit("1"), F.length(half) + 1, F.lit("0")).cast("decimal(38,0)"))
    return F.concat(done["left"], done["right"])


def _permuted_ip(ip: Column, key: str) -> Column:
    """Keyed permutation of the addresses, by halves of 16 bits (five digits)."""
    part = F.split(ip, r"\.")
    half = lambda i: F.lpad((part[i].cast("int") * 256 + part[i + 1].cast("int")).cast("string"), 5, "0")
    done = _feistel(F.struct(half(0).alias("left"), half(2).alias("right")), key, F.lit("ip"), lambda _: F.lit(5),
                    lambda _: F.lit(65536).cast("decimal(38,0)"))
    numbers = [done[side].cast("int") for side in ("left", "right")]
    return F.concat_ws(".", *[x.cast("int").cast("string") for n in numbers for x in (F.floor(n / 256), n % 256)])


def _refilled(shape: Column, signs: Column, which: str = "[0-9]") -> Column:
    """``shape`` with its digits, or the signs that match ``which``, replaced in order."""
    done = F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda s, c: F.when(c.rlike(which), F.struct(F.concat(s["out"], F.substring(signs, s["next"], F.lit(1))).alias("out"),
                                                      (s["next"] + 1).alias("next")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))))
    return done["out"]


def _bare(iban: Column) -> Column:
    return F.regexp_replace(iban, " ", "")


def _permuted_iban(iban: Column, key: str) -> Column:
    """Country, blanks and the places of digits and letters stay. Digits are permuted; each letter moves by a keyed number
    of places that the digits give, so this too can be undone and different accounts stay different."""
    shape = F.substring(iban, F.lit(3), F.length(iban))
    digits, letters = F.regexp_replace(shape, "[^0-9]", ""), F.regexp_replace(shape, "[^A-Z]", "")
    hexed = _keyed(key, "iban", F.substring(iban, 1, 2), digits)
    by = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % 25 + 1
    moved = F.transform(F.split(letters, ""), lambda c, i: F.when(c == "", c).otherwise(F.char((F.ascii(c) - 65 + by(i)) % 26 + 65)))
    return F.concat(F.substring(iban, 1, 2), _refilled(_refilled(shape, F.array_join(moved, ""), "[A-Z]"), _permuted(digits, f"{key} iban")))


def _syllables(key: str, entity: Column, script: str, number: int = 9) -> Column:
    """Six bits a syllable."""
    hexed = _keyed(key, script, entity)
    table = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    at = [F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).cast("int") % len(SYLLABLES[script]) + 1 for i in range(number)]
    return F.concat(*[F.element_at(table, i) for i in at])


def _given(key: str, given: Column, script: str) -> Column:
    """The name a keyed number of places further in the list of the same script and gender: no two names meet."""
    out = given
    for gender in "fm":
        names = GIVEN[script, gender]
        shift = 1 + int(hashlib.sha256(f"{key} {gender}".encode()).hexdigest(), 16) % (len(names) - 1)
        listed = F.array(*[F.lit(n) for n in names])
        moved = F.element_at(listed, ((F.array_position(listed, given) - 1 + shift) % len(names) + 1).cast("int"))
        out = F.when(given.isin(names), moved).otherwise(out)
    return out


def surrogate(entity: Column, entity_kind: Column, key: str) -> Column:
    """The keyed replacement of one entity of a known kind."""
    digits = lambda text: _refilled(text, _permuted(F.regexp_replace(text, "[^0-9]", ""), key))
    tag = F.regexp_extract(F.lower(entity), r"([._+-]?\d{1,18})@", 1)
    email = F.concat(_syllables(key, F.lower(entity), "latin"), F.when(tag == "", F.lit("")).otherwise(digits(tag)), F.lit("@example.net"))
    lead = F.regexp_extract(entity, r"^(AKIA|[a-z_]+\s*[=:]\s*[\"']?)", 1)
    value = F.substring(entity, F.length(lead) + 1, F.length(entity))
    hexed = F.concat(_keyed(key, value), _keyed(key, "more", value))
    secret = F.concat(lead, F.when(lead == "AKIA", F.upper(F.substring(hexed, 1, 16))).otherwise(
        F.substring(hexed, F.lit(1), F.greatest(F.length(value), F.lit(16)))))
    head, tail = F.regexp_extract(entity, r"^(\S+) ", 1), F.regexp_extract(entity, r" (.*)$", 1)
    named = lambda first, script: F.concat(first, F.lit(" "), F.initcap(_syllables(key, tail, script)))
    return (F.when(entity_kind.isin("card", "ssn", "phone"), digits(entity))
            .when(entity_kind == "ip", _permuted_ip(entity, key))
            .when(entity_kind == "email", email)
            .when(entity_kind == "secret", secret)
            .when(entity_kind == "iban", _permuted_iban(entity, key))
            .when(entity_kind == "titled", named(head, "latin"))
            .when(entity_kind == "person_latin", named(_given(key, head, "latin"), "latin"))
            .when(entity_kind == "person_cyrillic", named(_given(key, head, "cyrillic"), "cyrillic")))


def _entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def known_entities(docs: DataFrame) -> DataFrame:
    """(entity, kind) of all documents, each once."""
    found = docs.select(F.explode(_entities(F.col("text"))).alias("entity")).distinct()
    return found.select("entity", kind(F.col("entity")).alias("kind"))


Moved = dict[str, int]  # of the entities that had to get a further number in their key


def _numbered(entity: Column, entity_kind: Column, key: str, moved: Moved) -> Column:
    """The surrogate under the key and the entity's number, 0 for nearly all."""
    out = surrogate(entity, entity_kind, f"{key}/0")
    for number in sorted(set(moved.values())):
        own = [e for e, n in moved.items() if n == number]
        out = F.when(entity.isin(own), surrogate(entity, entity_kind, f"{key}/{number}")).otherwise(out)
    return out


def clashes(entities: DataFrame, key: str, moved: Moved) -> list[str]:
    """Entities whose replacement is another's as well, all but the first of each, and those left as they were. An e-mail
    address in other letter case is the same, and so is an account number with other blanks: they move together."""
    own = F.when(F.col("kind") == "email", F.lower("entity")).when(F.col("kind") == "iban", _bare(F.col("entity"))).otherwise(F.col("entity"))
    # the work is in the keyed columns, so the few distinct rows must not be merged into one task
    spread = entities.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity")
    made = cut(spread.select("kind", "entity", own.alias("own"), _numbered(F.col("entity"), F.col("kind"), key, moved).alias("made")))
    bare = F.when(F.col("kind") == "iban", _bare(F.col("made"))).otherwise(F.col("made"))
    first = made.groupBy("kind", bare.alias("bare")).agg(F.min("own").alias("first"), F.max("own").alias("last"))
    shared = first.where(F.col("first") != F.col("last")).select("kind", "bare", "first")
    late = made.withColumn("bare", bare).join(shared, ["kind", "bare"]).where(F.col("own") != F.col("first")).select("entity")
    same = made.where(F.col("made") == F.col("entity")).select("entity")
    return sorted(r["entity"] for r in late.unionByName(same).distinct().collect())  # a few even among very many entities


def keeps_apart(entities: DataFrame, key: str) -> bool:
    """No two entities share a replacement under the key alone, and none is left as it was."""
    return not clashes(entities, key, {})


def separated(entities: DataFrame, key: str) -> Moved:
    """The numbers under which all replacements differ."""
    moved: Moved = {}
    while found := clashes(entities, key, moved):
        moved |= {e: moved.get(e, 0) + 1 for e in found}
    return moved


def _name_parts(entities: Column) -> Column:
    """Of the people among found entities (kind, entity, surrogate): each part of the name and what replaces it, longest first."""
    people = F.filter(entities, lambda e: e["kind"].isin("titled", "person_latin", "person_cyrillic"))
    part = lambda old, new: F.struct((-F.length(old)).alias("order"), old.alias("old"), new.alias("new"))
    first, rest = (lambda t: F.regexp_extract(t, r"^(\S+) ", 1)), (lambda t: F.regexp_extract(t, r" (.*)$", 1))
    both = F.transform(people, lambda e: F.array_compact(F.array(
        part(rest(e["entity"]), rest(e["surrogate"])),
        F.when(e["kind"] != "titled", part(first(e["entity"]), first(e["surrogate"]))))))
    return F.array_sort(F.array_distinct(F.flatten(both)))


def _later_mentions(text: Column, parts: Column) -> Column:
    """``text`` with every stand-alone part of a found name replaced; a part that two names share goes by the first."""
    edge = f"{_UP}{_LOW}А-яёЁ"
    return F.aggregate(parts, text, lambda t, p: F.regexp_replace(
        t, F.concat(F.lit(f"(?<![{edge}])"), p["old"], F.lit(f"(?![{edge}])")), p["new"]))


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (entities replaced), entities (array of kind and replacement), key_generation.

    NULL texts stay NULL and empty ones empty, both without entities; each row is answered for itself, so ids may be NULL
    or repeated; an empty table gives an empty result; further columns are not read.
    """
    docs = plain(docs, id_col, text_col)
    entities = cut(known_entities(docs))
    moved = separated(entities, key)
    made = F.transform("found", lambda e: F.struct(kind(e).alias("kind"), e.alias("entity")))
    made = F.transform(made, lambda e: F.struct(
        e["kind"].alias("kind"), e["entity"].alias("entity"), _numbered(e["entity"], e["kind"], key, moved).alias("surrogate")))
    found = docs.withColumn("found", F.coalesce(_entities(F.col("text")), F.array().cast("array<string>"))).withColumn("made", made)
    # the pieces between entities, in which parts of found names are replaced, each followed by the next replacement
    found = found.withColumn("parts", _name_parts(F.col("made")))
    pieces = F.transform(F.split("text", ANY), lambda t: F.when(F.size("parts") > 0, _later_mentions(t, F.col("parts"))).otherwise(t))
    woven = F.zip_with(pieces, "made", lambda t, e: F.concat(t, F.coalesce(e["surrogate"], F.lit(""))))
    shown = F.transform("made", lambda e: F.struct(e["kind"].alias("kind"), e["surrogate"].alias("surrogate")))
    return found.select(
        "doc_id", F.when(F.size("made") > 0, F.array_join(woven, "")).otherwise(F.col("text")).alias("text"),
        shown.alias("entities"), F.lit(max(moved.values(), default=0)).alias("key_generation"))
