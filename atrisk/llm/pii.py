"""Keyed surrogates for personal data, in DataFrame functions only.

Entities (e-mail addresses, telephone numbers, IP addresses, card and identity numbers,
secrets, names after a title and the same names elsewhere in the text) are found by
patterns in the whole text and replaced by a keyed, format-preserving permutation of their characters: digits become digits, letters
become letters of the same script and case, vowels vowels and consonants consonants,
everything else stays; letters of a script without an alphabet become Latin ones. A
four-round Feistel network over the two halves makes the replacement one-to-one among
strings of a type and format, so one entity has the same surrogate in every document.
First names of a known gender are exchanged within their gender. What still falls
together or stays as it is (short words, other scripts) is found over all distinct parts
of entities, and :func:`exceptions` gives just these further rounds until none is left;
they alone are joined back, by the texts that hold them.

Deliberately not detected: names that follow no title anywhere in the text, single words
of a name but its last, names cut by a line end, lower-case names; national numbers in
one run of digits, in groups other than those of ``PATTERNS["national"]``, or with an
extension; keys of fewer than 24 characters without a known start, with fewer than three
digits or in base64 with ``+`` and ``/``; hex without a digit; IPv6 and postal addresses,
dates of birth, user names, quoted local parts, addresses with an encoded or spelt @.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
#: Further rounds of clashing parts that keep the format.
FORMAT_ROUNDS = 3
MARK = "\x01"
AT, OTHER = "_text_hash", "_other"

# Alphabets within which a character is exchanged.
DIGITS = "0123456789"
ALPHABETS = [DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áàâäéèêëíìîïóòôöúùûü", "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "çñßšžčłń", "ÇÑŠŽČŁŃ", "аеиоуыэюяё", "бвгджзклмнпрстфхцчшщйъь", "АЕИОУЭЮЯЁ", "БВГДЖЗКЛМНПРСТФХЦЧШЩЙ", "αεηιουω", "βγδζθκλμνξπρστφχψς", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
#: Letters and digits of a script without an alphabet; Latin letters and digits stand for them.
FOREIGN = r"[\p{L}\p{N}&&[^" + "".join(ALPHABETS) + "]]"
LATIN = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
HEX = ["0123456789abcdef"]
HEX_UPPER = ["0123456789ABCDEF"]
# Titles and common first names by gender.
TITLES = "Mr Mrs Ms Miss Sir Madam Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme Mlle".split()
MALE = "James John Robert Michael William David Richard Thomas Charles Daniel Paul Mark Peter Hans Klaus Jürgen Pierre Jean Michel Carlos José Luis Miguel".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Laura Emma Ursula Monika Petra Marie Sophie Camille Carmen María Lucía Elena".split()

_OCTETS = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
#: Words of a name: with a capital or an initial, particles between them; 's stays outside.
#: Repeated groups are possessive or bounded: the matcher would recurse once for each turn of others.
_NAME = r"\p{Lu}(?:\.(?=[ \u00a0]\p{L})|(?:[\p{L}\p{M}]|['’-](?=\p{L})(?!s(?!\p{L})))++)"
_PARTICLE = r"(?:v[oa]n(?:[ \u00a0](?:de[rnm]?|het))?|vom|zu[mr]?|de|del|della|di|da|dos|du|las?|los|le|te[nr]|bin|ibn|al)"
_TITLED = rf"(?:(?:{'|'.join(TITLES)})\.?[ \u00a0]++)++"
_HOST = r"[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+"
#: Starts of well-known keys; they are kept.
_KEY_HEAD = r"(?:A[KS]IA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abeprs]-|hf_|npm_|[spr]k[-_](?:(?:live|test|proj|ant|or)[-_])?)"
PATTERNS = {
    # starts once in a run of the characters of a local part, which may be of any length
    "email": r"(?<![\p{L}\p{N}_])(?<![\p{L}\p{N}_][.%+-]{1,8})[\p{L}\p{N}_][\p{L}\p{N}._%+-]*+@" + rf"{_HOST}(?:\.{_HOST})++",
    "secret": rf"(?<!@)(?:(?=[a-fA-F]*[0-9])[0-9a-fA-F]{{32,}}+(?![\p{{L}}\p{{N}}])|{_KEY_HEAD}(?=[A-Za-z_-]*[0-9])[0-9A-Za-z](?:[_-]?[0-9A-Za-z]){{15,}}+(?![\p{{L}}\p{{N}}])|(?=(?:[A-Za-z]*[0-9]){{3}})(?=[0-9]*[A-Za-z])[0-9A-Za-z]{{24,}}+(?![\p{{L}}\p{{N}}_]))",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "identity": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    # 3-3-4 digits; 9 digits in groups from 6 on; 8 to 15 digits from 0 on in groups, but no date
    "national": r"(?:1[ .-])?[2-9][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|[6-9][0-9]{2}(?:(?:[ -][0-9]{3}){2}|(?:[ -][0-9]{2}){3})(?![ -]?[0-9])|[89][0-9][ -][0-9]{3}(?:[ -][0-9]{2}){2}(?![ -]?[0-9])|(?![0-9]{2}[./-][0-9]{2}[./-][0-9]{4}(?![0-9]))(?=(?:[0-9][ ./-]?){7,14}[0-9](?![0-9]))0[0-9]{1,5}(?:[ ./-][0-9]{2,8}){1,5}(?![0-9])",
    "name": rf"{_TITLED}(?:{_PARTICLE}[ \u00a0]++)*+{_NAME}(?:[ \u00a0](?:{_PARTICLE}[ \u00a0]++)*+{_NAME})*+",
}
#: An entity starts where no word goes on; e-mail addresses come first, as they hold dots,
#: and may follow an @.
ANY = r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_+(])(?:" + PATTERNS["email"] + r"|(?<!@)(?:" + "|".join(v for k, v in PATTERNS.items() if k != "email") + "))"


def _kind(value: Column) -> Column:
    out = F.lit("name")
    for kind in ("national", "card", "identity", "ip", "phone", "secret"):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return F.when(value.contains("@"), "email").otherwise(out)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _exchanged(s: Column, by: Column, alphabets: list[str]) -> Column:
    """Moves each character on in its alphabet by two hex digits of ``by``."""

    letters = "".join(alphabets)
    # by place among all letters: the size of its alphabet and how many letters precede that
    sizes = "".join(chr(len(a)) * len(a) for a in alphabets)
    before = "".join(chr(1 + len("".join(alphabets[:k]))) * len(a) for k, a in enumerate(alphabets))

    def one(c: Column, i: Column) -> Column:
        step = F.conv(F.substring(by, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        place = F.instr(F.lit(letters), c)
        first = F.ascii(F.substring(F.lit(before), place, F.lit(1)))
        moved = first + (place - first + step) % F.ascii(F.substring(F.lit(sizes), place, F.lit(1)))
        return F.when(place > 0, F.substring(F.lit(letters), moved, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_characters(s), one), "")


def _romanised(s: Column, key: str) -> Column:
    """Puts keyed Latin letters and digits in place of what no alphabet holds. This is not
    one-to-one; :func:`exceptions` parts those that fall together."""

    def put(digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            step = F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            drawn = lambda a: F.substring(F.lit(a), step % len(a) + 1, F.lit(1))
            return F.when(c.rlike(FOREIGN), F.when(c.rlike(r"\p{N}"), drawn(DIGITS)).when(c.rlike(r"\p{Lu}"), drawn(LATIN[1])).otherwise(drawn(LATIN[0]))).otherwise(c)

        return F.array_join(F.transform(_characters(s), one), "")

    return F.when(s.rlike(FOREIGN), _bound(F.sha2(F.concat_ws("|", F.lit(key), F.lit("foreign"), s), 256), put)).otherwise(s)


def permuted(value: Column, key: str, domain: str, alphabets: list[str]) -> Column:
    """A keyed one-to-one image of a string among those of its format."""
    if alphabets is ALPHABETS:
        value = _romanised(value, key)

    def network(v: Column) -> Column:
        half = F.floor((F.length(v) + 1) / 2).cast("int")
        halves = F.struct(F.substring(v, F.lit(1), half).alias("a"), F.substring(v, half + 1, F.length(v)).alias("b"))

        def step(x: Column, r: Column) -> Column:
            digest = lambda other: F.sha2(F.concat_ws("|", F.lit(key), F.lit(domain), r.cast("string"), F.length(v).cast("string"), other), 256)
            a = _bound(digest(x["b"]), lambda d: _exchanged(x["a"], d, alphabets))
            b = _bound(digest(x["a"]), lambda d: _exchanged(x["b"], d, alphabets))
            return F.when(r % 2 == 0, F.struct(a.alias("a"), x["b"].alias("b"))).otherwise(F.struct(x["a"].alias("a"), b.alias("b")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, step, lambda x: F.concat(x["a"], x["b"]))

    return _bound(value, network)


def _digits(value: Column, key: str, kind: str, kept: str) -> Column:
    """Permutes a number's digits; separators and what matches ``kept`` at its start stay."""

    def whole(v: Column) -> Column:
        head = F.regexp_extract(v, kept, 0)
        tail = F.substring(v, F.length(head) + 1, F.length(v))
        own = F.regexp_replace(tail, "[^0-9]", "")

        def placed(d: Column) -> Column:
            put = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(d, F.length(F.regexp_replace(F.substring(tail, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)
            return F.concat(head, F.array_join(F.transform(_characters(tail), put), ""))

        return _bound(permuted(own, key, kind, [DIGITS]), placed)

    return _bound(value, whole)


def _address(value: Column, key: str) -> Column:
    """Permutes an IP address: 32 bits as hex digits, back to four octets. What has an octet
    over 255 or with a leading zero is no such number, so its digits are permuted."""
    octets = lambda v: F.array_join(F.transform(F.split(v, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("long") % 256)), 2, "0")), "")
    back = lambda h: F.concat_ws(".", *(F.conv(F.substring(h, F.lit(i), F.lit(2)), 16, 10) for i in (1, 3, 5, 7)))
    return F.when(value.rlike(_OCTETS), _bound(permuted(octets(value), key, "ip", HEX), back)).otherwise(_digits(value, key, "octets", "^$"))


def _words(name: Column) -> Column:
    """The words of a name and the blanks between them."""
    return F.split(name, "(?<=[ \u00a0])|(?=[ \u00a0])")


def _own(word: Column) -> Column:
    """Whether a word of a name has a capital and is not a title."""
    return word.rlike(r"^\p{Lu}") & ~word.rlike(rf"^(?:{'|'.join(TITLES)})\.?$")


def _word(value: Column, key: str) -> Column:
    """Exchanges a known first name within its gender, permutes any other word."""
    step = int.from_bytes(__import__("hashlib").sha256(f"{key}|first".encode()).digest()[:4], "big")

    def word(w: Column) -> Column:
        out = permuted(w, key, "name", ALPHABETS)
        for names in (MALE, FEMALE):
            at = F.array_position(F.array(*map(F.lit, names)), w)
            out = F.when(at > 0, F.get(F.array(*map(F.lit, names)), ((at - 1 + 1 + step % (len(names) - 1)) % len(names)).cast("int"))).otherwise(out)
        return out

    return _bound(value, word)


def _whole(v: Column, kind: Column, key: str) -> Column:
    """The image of an entity that is replaced in one piece: a number or a secret."""
    hexadecimal = F.when(v.rlike("[a-f]"), permuted(v, key, "secret", HEX)).otherwise(permuted(v, key, "secret", HEX_UPPER))
    head = F.regexp_extract(v, f"^{_KEY_HEAD}", 0)
    secret = F.when(v.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), hexadecimal).otherwise(F.concat(head, permuted(F.substring(v, F.length(head) + 1, F.length(v)), key, "secret", [DIGITS, *LATIN])))
    return (
        F.when(kind == "secret", secret)
        .when(kind == "phone", _digits(v, key, "phone", r"^\+[0-9]{1,3}(?=[^0-9])"))
        .when(kind == "ip", _address(v, key))
        .when(kind == "identity", _digits(v, key, "identity", "^$"))
        .when(kind == "national", _digits(v, key, "national", "^0"))
        .otherwise(_digits(v, key, "card", "^$"))
    )


def _image(space: Column, part: Column, key: str) -> Column:
    """The image of a part: a word of a name, a local part, a domain label or a whole entity."""
    return (
        F.when(space == "name", _word(part, key))
        .when(space == "local", permuted(part, key, "email", ALPHABETS))
        .when(space == "label", permuted(part, key, "domain", ALPHABETS))
        .otherwise(_whole(part, _kind(part), key))
    )


def _labels(at: Column) -> Column:
    return F.split(F.get(at, F.lit(1)), r"\.")


def _parts(entity: Column) -> Column:
    """The parts of an entity that are replaced, each with its space. Images that differ
    within the spaces make replacements that differ."""

    def of(v: Column) -> Column:
        kind, at = _kind(v), F.split(v, "@")
        made = lambda space, c: F.struct(F.lit(space).alias("space"), c.alias("part"))
        labels = F.transform(F.slice(_labels(at), 1, F.size(_labels(at)) - 1), lambda w: made("label", w))
        return (
            F.when(kind == "email", F.concat(F.array(made("local", F.get(at, F.lit(0)))), labels))
            .when(kind == "name", F.transform(F.filter(_words(v), _own), lambda w: made("name", w)))
            .otherwise(F.array(made("whole", v)))
        )

    return _bound(entity, of)


def surrogate(value: Column, key: str, other: Column | None = None) -> Column:
    """The replacement of one entity as it stands in the text; ``other`` maps ``space:part``
    to the image of the parts for which it isn't the key's own."""

    def of(v: Column) -> Column:
        kind = _kind(v)
        made = lambda space, part, image: image if other is None else F.coalesce(F.element_at(other, F.concat(F.lit(f"{space}:"), part)), image)
        # the part before @ and each label but the last, by themselves: one domain stays one
        at = F.split(v, "@")
        labels = _labels(at)
        domain = _bound(labels, lambda all_: F.array_join(F.transform(all_, lambda w, i: F.when(i == F.size(all_) - 1, w).otherwise(made("label", w, permuted(w, key, "domain", ALPHABETS)))), "."))
        local = F.get(at, F.lit(0))
        email = F.concat(made("local", local, permuted(local, key, "email", ALPHABETS)), F.lit("@"), domain)
        name = F.array_join(F.transform(_words(v), lambda w: F.when(_own(w), made("name", w, _word(w, key))).otherwise(w)), "")
        return F.when(kind == "email", email).when(kind == "name", name).otherwise(made("whole", v, _whole(v, kind, key)))

    return _bound(value, of)


def _cut(text: Column, pattern: Column | str) -> Column:
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK)
    # a text that holds the mark itself is cut the longer way
    one = F.lit(pattern) if isinstance(pattern, str) else pattern
    between, found = F.split(text, one, -1), F.regexp_extract_all(text, one, F.lit(0))
    woven = F.flatten(F.transform(between, lambda p, i: F.when(i < F.size(found), F.array(p, F.get(found, i))).otherwise(F.array(p))))
    return F.when(F.instr(text, MARK) > 0, woven).otherwise(marked)


def _untitled(cut: Column) -> Column:
    """The names after a title without it, and their last words, longer ones first."""
    titled = F.filter(cut, lambda p, i: (i % 2 == 1) & p.rlike(f"^{_TITLED}"))
    bare = F.transform(titled, lambda p: F.regexp_replace(p, f"^{_TITLED}", ""))
    last = F.filter(F.transform(bare, lambda p: F.regexp_extract(p, r"[^ \u00a0]+$", 0)), lambda w: w.rlike(r"^\p{L}{3}"))
    return F.sort_array(F.array_distinct(F.concat(bare, last)), asc=False)


def pieces(text: Column) -> Column:
    """The text cut at its entities: those are the elements with an odd index. A name that
    follows a title somewhere in the text is also found without one."""

    def again(cut: Column) -> Column:
        def by(names: Column) -> Column:
            pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}@_])(?:\Q"), F.array_join(names, r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{N}])"))
            return F.when(F.size(names) > 0, F.flatten(F.transform(cut, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(_cut(p, pattern))))).otherwise(cut)

        return _bound(_untitled(cut), by)

    return _bound(_cut(text, ANY), again)


def entities(docs: DataFrame) -> DataFrame:
    """The distinct entities: ``kind, entity``."""
    found = docs.filter(F.col("text").isNotNull()).select(F.filter(pieces(F.col("text")), lambda _, i: i % 2 == 1).alias("found"))
    return found.select(F.explode("found").alias("entity")).distinct().select(_kind(F.col("entity")).alias("kind"), "entity")


def clashes(found: DataFrame, key: str) -> DataFrame:
    """Surrogates that two entities share, or that are their own entity."""
    made = found.withColumn("made", surrogate(F.col("entity"), key))
    return made.groupBy("kind", "made").agg(F.count("*").alias("n"), F.max(F.col("made") == F.col("entity")).alias("own")).filter("n > 1 or (own and made rlike '[0-9a-zA-Z]')")


def exceptions(found: DataFrame, key: str) -> DataFrame | None:
    """The parts (``space, part``) whose image under ``key`` is the part itself or also that
    of another, with an image of their own in ``made``; None if there are none.

    Just these get a further keyed round, until none is left. An image counts once no part
    has it, not even one of an earlier round. The first rounds keep the format; each later
    one adds a character, so a format without a free string (one letter, say) ends it too.
    """
    from atrisk.llm.common import written

    table = written(found.withColumn("made", _image(F.col("space"), F.col("part"), key)), "images")
    groups = table.groupBy("space", "made").agg(F.count("*").alias("n"), F.min(F.when(F.col("part") != F.col("made"), F.col("part"))).alias("first"), F.max(F.col("part") == F.col("made")).alias("own")).filter("n > 1 or own")
    left = written(table.join(groups, ["space", "made"]).filter("first is null or part <> first").select("space", "part"), "clashing")
    if left.isEmpty():
        return None
    taken, done, i = table.select("space", "made"), None, 0
    while not left.isEmpty():
        i += 1
        variant = f"{key}#{i}"
        image = _image(F.col("space"), F.col("part"), variant)
        if i > FORMAT_ROUNDS:
            drawn = F.substring(F.sha2(F.concat_ws("|", F.lit(variant), F.col("space"), F.col("part")), 256), 1, min(i - FORMAT_ROUNDS, 64))
            more = F.when(F.col("space") == "whole", F.translate(drawn, "abcdef", "012345")).otherwise(F.translate(drawn, "0123456789abcdef", "bcdfghjkmnpqrstv"))
            image = F.concat(image, more)
        tried = written(left.withColumn("made", image), "tried")
        used = taken.join(tried.select("space", "made"), ["space", "made"], "left_semi").distinct()
        free = tried.filter("made <> part").join(used, ["space", "made"], "left_anti")
        fixed = written(free.groupBy("space", "made").agg(F.min("part").alias("part")).select("space", "part", "made"), "fixed")
        left = written(left.join(fixed, ["space", "part"], "left_anti"), "clashing")
        taken, done = taken.unionByName(fixed.select("space", "made")), fixed if done is None else done.unionByName(fixed)
    return done


def _replaced(docs: DataFrame, key: str) -> tuple[DataFrame, Column | None]:
    """``docs``, and where parts need images of their own, with a map of those in the text.
    The map is joined by the text's hash, as the ids may be null or repeated."""
    from atrisk.llm.common import written

    cut = F.flatten(F.transform(F.filter(pieces(F.col("text")), lambda _, i: i % 2 == 1), _parts))
    found = written(docs.filter(F.col("text").isNotNull()).select(F.sha2("text", 256).alias(AT), cut.alias("parts")).filter(F.size("parts") > 0), "found")
    each = found.select(AT, F.inline("parts"))
    other = exceptions(each.select("space", "part").distinct(), key)
    if other is None:
        return docs, None
    pair = F.struct(F.concat_ws(":", "space", "part").alias("k"), F.col("made").alias("v"))
    maps = each.join(other, ["space", "part"]).groupBy(AT).agg(F.map_from_entries(F.collect_set(pair)).alias(OTHER))
    return docs.withColumn(AT, F.sha2("text", 256)).join(maps, AT, "left").drop(AT), F.col(OTHER)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with entities replaced in ``text`` and n_chars, where there is
    such a column, set to the new length. A null text stays null; rows are independent of
    each other, so repeated rows and null ids need no care."""
    rows, other = _replaced(docs, key)
    out = rows.withColumn("text", _rewritten(pieces(F.col("text")), key, other)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _rewritten(cut: Column, key: str, other: Column | None) -> Column:
    return F.array_join(F.transform(cut, lambda p, i: F.when(i % 2 == 1, surrogate(p, key, other)).otherwise(p)), "")


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_entities``: every document with its entities replaced."""
    rows, other = _replaced(docs, key)
    cut = rows.select("doc_id", pieces(F.col("text")).alias("cut"), *([] if other is None else [other]))
    return cut.select("doc_id", _rewritten(F.col("cut"), key, other).alias("text"), F.coalesce(F.floor(F.size("cut") / 2), F.lit(0)).cast("long").alias("n_entities"))
