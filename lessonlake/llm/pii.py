"""PII surrogates, with DataFrame functions alone.

Emails, phone numbers, IPv4 addresses, card numbers, IBANs, social security numbers, secrets and titled person names are
found by one pattern and replaced by keyed surrogates of the same type:

* format: separators, lengths, letter case and kind of each character stay; a card keeps its first digit and whether its Luhn sum is
  right, an address has valid octets of as many digits, an email keeps its top-level domain, hex stays hex;
* gender and script: given names are built for the title's gender (of either where the title has none) in Latin, Cyrillic or Greek; other
  letters move within their script;
* coreference: a surrogate depends on the key and the entity alone (emails without case, numbers without separators, names by
  part), so all mentions in all documents agree, and a mail domain or a surname stays shared by those who share it. A mail domain is
  an entity of its own, so two domains never become one, nor one a real one of the table;
* distinctness: the distinct entities of the whole table are checked. Where two get one surrogate, or one gets the
  text of a real entity, all but the first in order are drawn again until none is left. From draw WIDER on the format widens, as a
  table may hold more entities of a format than half of its texts: an address has octets of any length, any other surrogate but a
  card's and a hex string's (over 10^12 forms) gets one more character a draw, and letters of other scripts become Latin ones.

Defined results: a null text stays null with 0 entities; an empty text, or one without entities, is unchanged; repeated rows get
equal results; an empty table gives an empty result. Other columns may have any name: all of them are kept by replace_pii(), and where
one is called n_entities, the new one has a longer name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.common import Tables, fresh, materialise

#: Exceptions that may be carried as a literal map; more go through a join.
LITERAL_EXCEPTIONS = 500
#: The draw from which a surrogate may be longer than its entity.
WIDER = 8
#: Titles by gender (fixed values).
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος", "Κύριε"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Signora", "Госпожа", "Κυρία"),
    "x": ("Dr", "Prof", "Professor", "Doctor", "Доктор", "Профессор"),
}
#: Words before a secret, in any case (fixed values).
SECRET_WORDS = "(?i:password|passwd|pwd|secret|token|api_key|apikey)"
#: What may stand behind a title, and before a surname (fixed values).
DEGREES = "med|phil|jur|rer|nat|habil|dent"
PARTICLES = "de la|de los|de|del|della|di|da|dos|van der|van den|van|von der|von|zu|le|la|bin|al"
NAME = r"(?:\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)*|\p{Lu}{2,}(?:[-'’]\p{Lu}{2,})*)"
TITLE = "|".join(t for g in TITLES.values() for t in sorted(g, key=len, reverse=True))
#: One title or several: Frau Prof. Dr. med.
TITLED = rf"(?:{TITLE})\.? (?:(?:{TITLE}|{DEGREES})\.? )*"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){3}(?!\d)|(?<!\d)3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"
    rf"|(?<={SECRET_WORDS}[ ]{{0,2}}[=:][ ]{{0,2}}[\"']{{0,1}})[A-Za-z0-9+/_-]{{6,}}",
    "person": rf"(?<!\p{{L}}){TITLED}(?:(?:{PARTICLES}) )?{NAME}(?: (?:(?:{PARTICLES}) )?{NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every match of ANY holds one of these, which are found faster: the patterns without their look-arounds, or a part of each match.
#: A secret's key word stands before the match.
SIGN = rf"[@\d]|{SECRET_WORDS}[ ]{{0,2}}[=:]|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20}}|[a-f]{{32}}|[A-F]{{32}}|(?:{TITLE})\.? \p{{L}}"
#: Scripts: (first code point, letters) of ranges within which a letter moves (fixed values).
RANGES = (
    (0x30, 10), (0x61, 26), (0x41, 26), (0xE0, 23), (0xC0, 23), (0xF8, 7), (0xD8, 7), (0x430, 32), (0x410, 32), (0x3B1, 17), (0x3C3, 7),
    (0x391, 17), (0x3A3, 7), (0x5D0, 27), (0x621, 26), (0x905, 53), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172),
)
#: Syllables and gendered endings of given names, by script (fixed values).
SYLLABLES = {
    "latin": ("al be ca da el fe ga ha il jo ka le ma ni or pe ro sa ti va".split(), {"m": "no ro do lf rd us in co".split(), "f": "na ra da lla ria ssa ina ca".split()}),
    "cyrillic": ("ал бе ва га да ев зо ил ка ле ма ни ор пе ро са ти ул фе яр".split(), {"m": "ан ей ил ор ур им ат ен".split(), "f": "на ра да ля рия ша ина ва".split()}),
    "greek": ("αλ βε γα δα ελ ζη θε ιλ κα λε μα νι ορ πε ρο σα τι φα χα ψε".split(), {"m": "νος ρος δης λης ων ας ις μος".split(), "f": "να ρα δα λη ρια σα ινα κη".split()}),
}


def kind_of(mention: Column) -> Column:
    out = F.when(mention.contains("@"), "email")
    for kind in ("ip", "phone", "ssn", "card", "iban", "hex"):
        # the pattern found the mention among others already, so its look-arounds hold
        out = out.when(mention.rlike(rf"^(?:{PATTERNS[kind]})$"), kind)
    return out.when(mention.rlike(rf"^{TITLED}"), "person").otherwise("secret")


def byte_at(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i - 1, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once and written once in the plan."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def moved(c: Column, shift: Column, other: Column | None = None) -> Column:
    """A letter or digit moved within its script and case by a keyed shift; for any other character, other or itself."""
    ranges = F.array(*[F.struct(F.lit(first).alias("first"), F.lit(n).alias("n")) for first, n in RANGES])
    code = F.ascii(c)

    def to(r: Column) -> Column:
        step = shift * F.when(r["n"] < 256, 1).otherwise(83)
        return F.when(r.isNull(), c if other is None else other).otherwise(_char(r["first"] + F.pmod(code - r["first"] + step, r["n"])))

    return _let(F.get(F.filter(ranges, lambda r: (code >= r["first"]) & (code < r["first"] + r["n"])), F.lit(0)), to)


def _each(text: Column, f) -> Column:
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: f(F.substring(text, i, F.lit(1)), i)), ""))


def digest_of(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lit(key), kind, attempt.cast("string"), canon), 512)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return total + F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def surrogate(key: str, entity: Column) -> Column:
    """The replacement of entity, a struct (kind, canon, attempt): of the same length but for given names and late draws."""
    return _let(entity, lambda e: _let(digest_of(key, e["kind"], e["canon"], e["attempt"]), lambda d: _surrogate(key, e["kind"], e["canon"], e["attempt"], d)))


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column, d: Column) -> Column:
    def latin(i: Column) -> Column:
        return _char(byte_at(d, i) % 26 + 0x61)

    def plain(text: Column, d: Column) -> Column:
        return _let(text, lambda t: _each(t, lambda c, i: moved(c, byte_at(d, i), F.when((attempt >= WIDER) & c.rlike(r"\p{L}"), latin(i)).otherwise(c))))

    def tail(text: Column) -> Column:
        """What a late draw adds to a surrogate: characters like the last of text."""
        def add(j: Column) -> Column:
            return _let(F.length(text) + j, lambda i: moved(F.right(text, F.lit(1)), byte_at(d, i), latin(i)))

        return F.when(attempt < WIDER, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), attempt - (WIDER - 1)), add), ""))

    def octet(o: Column, i: Column) -> Column:
        return _let(byte_at(d, i + 1) + byte_at(d, i + 21) * 256, lambda b: F.when(attempt >= WIDER, F.pmod(b, F.lit(255)) + 1).when(F.length(o) == 1, F.pmod(b, F.lit(9)) + 1).when(F.length(o) == 2, F.pmod(b, F.lit(90)) + 10).otherwise(F.pmod(b, F.lit(155)) + 100).cast("string"))

    def card() -> Column:
        body = F.concat(F.substring(canon, 1, 1), plain(F.substring(canon, F.lit(2), F.length(canon) - 2), d))
        return _let(body, lambda b: F.concat(b, F.pmod(luhn(canon) - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    def domain() -> Column:
        return _let(F.regexp_extract(canon, r"\.[^.]*$", 0), lambda top: _let(F.substring(canon, F.lit(1), F.length(canon) - F.length(top)), lambda body: F.concat(plain(body, d), tail(body), top)))

    def email() -> Column:
        # the domain is another entity: here it stands for itself, so that addresses of one domain are told apart
        return _let(F.split(canon, "@"), lambda x: F.concat(plain(F.get(x, F.lit(0)), d), tail(F.get(x, F.lit(0))), F.lit("@"), F.get(x, F.lit(1))))

    def given() -> Column:
        def built(script: str) -> Column:
            parts, ends = SYLLABLES[script]
            words = F.array(*map(F.lit, parts))
            male = (kind == "given m") | (kind == "given x") & (byte_at(d, F.lit(61)) < 128)
            last = F.when(male, F.array(*map(F.lit, ends["m"]))).otherwise(F.array(*map(F.lit, ends["f"])))
            # later draws are longer, so there are always enough names
            stem = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + attempt), lambda i: F.element_at(words, F.pmod(byte_at(d, i), F.lit(len(parts))) + 1)), "")
            return F.concat(stem, F.element_at(last, F.pmod(byte_at(d, F.lit(60)), F.lit(8)) + 1))

        return F.when(canon.rlike(r"^\p{IsCyrillic}"), built("cyrillic")).when(canon.rlike(r"^\p{IsGreek}"), built("greek")).when(canon.rlike(r"^\p{IsLatin}"), built("latin")).otherwise(F.concat(plain(canon, d), tail(canon)))

    hexed = _each(canon, lambda c, i: F.lower(F.conv(F.pmod(F.conv(c, 16, 10).cast("int") + byte_at(d, i), F.lit(16)).cast("string"), 10, 16)))
    # what stays of the others: a phone number's country, an IBAN's country, a key's prefix
    fixed = F.when(kind.isin("phone", "iban"), 2).when((kind == "secret") & canon.startswith("AKIA"), 4).otherwise(0)
    other = _let(fixed, lambda n: F.concat(F.substring(canon, F.lit(1), n), plain(F.substring(canon, n + 1, F.length(canon)), d), tail(canon)))
    return (
        F.when(kind == "email", email()).when(kind == "domain", domain()).when(kind == "ip", F.array_join(F.transform(F.split(canon, r"\."), octet), ".")).when(kind == "card", card())
        .when(kind == "hex", hexed).when(kind.startswith("given"), given()).otherwise(other)
    )


def words_of(mention: Column) -> Column:
    """The words of a person's mention behind its titles."""
    return F.split(F.regexp_replace(mention, rf"^{TITLED}", ""), " ")


def is_particle(word: Column) -> Column:
    return word.rlike(r"^\p{Ll}")


def parts_of(mention: Column, kind: Column) -> Column:
    """The entities of a mention: array<struct<kind, canon>>; a name has one a part but for its particles, an email one and its domain, any other
    mention one. Of several titles one with a gender counts."""
    of = lambda g: mention.rlike(rf"^(?:(?:{TITLE}|{DEGREES})\.? )*?(?:{'|'.join(TITLES[g])})\.? ")
    gender = F.when(of("m"), "given m").when(of("f"), "given f").otherwise("given x")

    def names(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "surname").otherwise(gender).alias("kind"), F.lower(w).alias("canon")))

    canon = (
        F.when(kind.isin("phone", "ssn", "card"), F.concat(F.when(mention.startswith("+"), "+").otherwise(F.when(kind == "phone", "(").otherwise("")), F.regexp_replace(mention, r"\D", "")))
        .when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind.isin("email", "hex"), F.lower(mention)).otherwise(mention)
    )
    entity = lambda kind, canon: F.struct(kind.alias("kind"), canon.alias("canon"))
    mail = F.array(entity(kind, F.lower(mention)), entity(F.lit("domain"), F.lower(F.substring_index(mention, "@", -1))))
    person = _let(F.filter(words_of(mention), lambda w: ~is_particle(w)), names)
    return F.when(kind == "person", person).when(kind == "email", mail).otherwise(F.array(entity(kind, canon)))


def entities_of(mention: Column) -> Column:
    return _let(kind_of(mention), lambda k: parts_of(mention, k))


def written_like(mention: Column, new: Column) -> Column:
    """new in the mention's format: its letters and digits fill the mention's places, in the mention's case; those of a late draw that are left follow.

    An email of another length stays as drawn."""

    def filled(chars: Column) -> Column:
        def add(acc, c):
            x = F.substring(chars, acc["n"] + 1, F.lit(1))
            ok = c.rlike(r"[\p{L}\p{Nd}]")
            put = F.when(~ok, c).when(c.rlike(r"\p{Lu}"), F.upper(x)).when(c.rlike(r"\p{Ll}"), F.lower(x)).otherwise(x)
            return F.struct((acc["n"] + F.when(ok, 1).otherwise(0)).alias("n"), F.concat(acc["out"], put).alias("out"))

        longer = F.length(chars) - F.length(F.regexp_replace(mention, r"[^\p{L}\p{Nd}]", ""))
        fill = F.aggregate(F.split(mention, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), add)["out"]
        return F.when(longer == 0, fill).when((longer < 0) | mention.contains("@"), new).otherwise(F.concat(fill, F.right(chars, longer)))

    return _let(F.regexp_replace(new, r"[^\p{L}\p{Nd}]", ""), filled)


def replaced(key: str, mention: Column, attempts) -> Column:
    """attempts(kind, canon): the draw that an entity's surrogate comes from."""

    def joined(k: Column) -> Column:
        new = F.transform(parts_of(mention, k), lambda p: surrogate(key, F.struct(p["kind"].alias("kind"), p["canon"].alias("canon"), attempts(p["kind"], p["canon"]).alias("attempt"))))
        title = F.regexp_extract(mention, rf"^{TITLED}", 0)

        def named(new: Column) -> Column:
            """The words with their surrogates, and particles as they are. A surname keeps its format; a given name is of another length."""
            def add(acc: Column, w: Column) -> Column:
                x = F.get(new, acc["n"])
                case = F.when(w.rlike(r"^\p{Lu}{2}"), F.upper(x)).otherwise(F.initcap(x))
                put = F.when(acc["n"] == F.size(new) - 1, written_like(w, x)).otherwise(case)
                at = acc["n"] + F.when(is_particle(w), 0).otherwise(1)
                return F.struct(at.alias("n"), F.concat(acc["out"], F.array(F.when(is_particle(w), w).otherwise(put))).alias("out"))

            words = F.aggregate(words_of(mention), F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")), add)["out"]
            return F.concat(title, F.array_join(words, " "))

        return _let(new, lambda n: F.when(k == "person", named(n)).otherwise(_let(F.when(k == "email", F.concat(F.substring_index(F.get(n, F.lit(0)), "@", 1), F.lit("@"), F.get(n, F.lit(1)))).otherwise(F.get(n, F.lit(0))), lambda x: F.when(k == "ip", x).otherwise(written_like(mention, x)))))

    return _let(kind_of(mention), joined)


def redrawn(entities: DataFrame, key: str, tables: Tables) -> DataFrame:
    """entities(kind, canon), distinct -> those whose first surrogate collides: kind, canon, attempt (1 or more)."""
    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    now = tables.write(entities.select("kind", "canon", F.lit(0).alias("attempt"), surrogate(key, F.struct("kind", "canon", F.lit(0).alias("attempt"))).alias("new")))
    real = now.select(group.alias("g"), F.col("canon").alias("new"), F.lit(True).alias("real")).distinct()
    while True:
        # a draw is lost to an entity that was not redrawn, then to one earlier in order
        rank = F.struct("attempt", "kind", "canon")
        held = now.withColumn("g", group)
        best = held.groupBy("g", "new").agg(F.min(rank).alias("best"), F.count("*").alias("k"))
        lost = (
            held.join(best.where("k > 1").drop("k"), ["g", "new"], "left").join(real, ["g", "new"], "left")
            .where((F.col("best").isNotNull() & (F.col("best") != rank)) | F.col("real")).select("kind", "canon", F.lit(1).alias("lost"))
        )
        lost = tables.write(lost)
        if lost.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt")
        next_ = F.col("attempt") + F.coalesce("lost", F.lit(0))
        again = now.join(lost, ["kind", "canon"], "left").select("kind", "canon", next_.alias("attempt"), F.col("new").alias("old"), "lost")
        now = tables.write(again.select("kind", "canon", "attempt", F.when(F.col("lost").isNull(), F.col("old")).otherwise(surrogate(key, F.struct("kind", "canon", "attempt"))).alias("new")))


def replace_pii(documents: DataFrame, key: str) -> DataFrame:
    """The documents, all columns, with replaced text, and the column n_entities (mentions replaced)."""
    mentions_, hash_, late_, count_ = (fresh(documents, n) for n in ("mentions", "text_hash", "late", "n_entities"))
    found = F.when(F.col("text").rlike(SIGN), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    marked = documents.withColumn(mentions_, F.coalesce(found, F.array().cast("array<string>")))
    mentions = marked.select(F.explode(mentions_).alias("m")).groupBy("m").count().select("m")
    entities = mentions.select(F.explode(entities_of(F.col("m"))).alias("p")).select("p.kind", "p.canon").distinct()
    with Tables(documents.sparkSession) as tables:
        late = materialise(redrawn(entities, key, tables))
    rows = late.limit(LITERAL_EXCEPTIONS + 1).collect()
    if len(rows) <= LITERAL_EXCEPTIONS:
        known = {(r["kind"], r["canon"]): r["attempt"] for r in rows}
        table = F.create_map(*[x for (k, c), a in known.items() for x in (F.lit(f"{k}\u001f{c}"), F.lit(a))]) if known else None
        attempts = lambda k, c: F.coalesce(F.try_element_at(table, F.concat(k, F.lit("\u001f"), c)), F.lit(0)) if known else F.lit(0)
    else:
        text_hash = F.xxhash64("text").alias(hash_)  # a text that shares another's hash gets more entries than it needs
        pairs = marked.select(text_hash, F.explode(mentions_).alias("m")).distinct().select(hash_, F.explode(entities_of(F.col("m"))).alias("p")).select(hash_, "p.kind", "p.canon").distinct()
        per_text = pairs.join(late, ["kind", "canon"]).groupBy(hash_).agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit("\u001f"), "canon"), "attempt"))).alias(late_))
        marked = marked.withColumn(hash_, text_hash).join(per_text, hash_, "left")
        attempts = lambda k, c: F.coalesce(F.try_element_at(F.col(late_), F.concat(k, F.lit("\u001f"), c)), F.lit(0))
    new = F.transform(mentions_, lambda m: replaced(key, m, attempts))
    # the gaps between mentions, one more than there are mentions
    gaps = F.split("text", ANY, -1)
    text = F.when(F.size(mentions_) == 0, F.col("text")).otherwise(F.array_join(F.zip_with(gaps, new, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), ""))
    return marked.withColumns({"text": text, count_: F.size(mentions_).cast("long")}).select(*documents.columns, count_)
