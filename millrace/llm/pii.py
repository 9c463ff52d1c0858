"""PII surrogates, in DataFrame operations only.

Detected entities (e-mail addresses, IPv4 and IPv6 addresses, telephone numbers, card and social security
numbers, account numbers, secrets, and names after a title) get surrogates that a secret key decides by
HMAC-SHA512: digits for digits, letters for letters, in the layout and the case of the place where they stand.
One entity has one surrogate in the whole corpus, however it is written there (punctuation of numbers, case of
addresses). Runs of digits are card numbers only with a card's first digit and check digit; the latter stays
valid.

Names are replaced word by word: a family name has one surrogate whatever stands before it, a first name one of
the gender that the titles of the corpus give it (so Mr Smith and Mr John Smith, Dr Ana Lopez and Mrs Ana Lopez
stay one), both of the word's script (Latin, Cyrillic or Greek; Latin for others). Where a text names a person
with a title, the full name and the family name are found there without one, too.

Distinct entities have distinct surrogates, and none is an entity of the corpus: candidates that collide are
drawn again, round by round, until none does. Rounds end, as later ones draw longer forms: e-mail addresses and
names from the second round on, other kinds from round SAME_LENGTH on (IPv4 addresses then become IPv6 ones).

Texts without an entity pass through untouched and unshuffled. Of the others each distinct text is treated
once; its digest joins the result back, a plain join that adaptive execution can split where copies are
many. Null texts stay null and empty ones empty. Repeated rows stay repeated. Columns of other names stay;
one named _n_entities is replaced.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The key where none is given; a secret one belongs in the setting millrace.pii.key or the argument.
KEY = "millrace"
SAME_LENGTH = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}"
_FEMALE, _MALE = "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Señora|Sra|Г-жа|Госпожа|Κυρία", "Mr|Monsieur|Herr|Señor|Sr|Г-н|Господин|Κύριος"
#: Kind and pattern (Java), in the order of precedence.
PATTERNS = [
    # Looking back first, and bounded repeats, keep the time linear in very long words.
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}"),
    ("ip", rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xoxb)[-_][0-9A-Za-z_-]{16,})(?![0-9A-Za-z])"),
    ("secret", r"(?<=[=:\s\"'])(?<=[=:]\s{0,3}[\"']?)(?<=(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[!-~&&[^\"'<>,;]]{6,}"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}(?:[0-9]{0,3})(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("name", rf"(?<![\p{{L}}])(?:{_FEMALE}|{_MALE}|Dr|Prof)\.? {_NAME}"),
]
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What every entity has, at a character that is quickly found: a text without it holds none.
_HINT = (
    r"[-_@0-9=: A](?:(?<=[@0-9])|(?<=[=:])(?<=(?i:password|passwd|pwd|token|secret|key)[\"']?\s{0,3}[=:])|(?<=:)(?=[A-Fa-f]{1,4}:)"
    rf"|(?<= )(?=\p{{Lu}})(?<=(?:{_FEMALE}|{_MALE}|Dr|Prof)\.? )|(?<=AKIA)|(?<=sk[-_]|ghp[-_]|xoxb[-_]))"
)
_LONG_HINT = "[a-f]{32}|[A-F]{32}"
_TITLE = rf"^(?:{_FEMALE}|{_MALE}|Dr|Prof)\.? "


def detect(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.when(text.rlike(_HINT) | text.rlike(_LONG_HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    named = [kp for kp in PATTERNS if not kp[1].startswith("(?<=")]
    return reduce(lambda rest, kp: F.when(entity.rlike(f"^(?:{_bare(kp[1])})$"), kp[0]).otherwise(rest), reversed(named), F.lit("secret"))


def _bare(pattern: str) -> str:
    """The pattern without what it asks of the surroundings at its start and end."""
    if pattern.startswith("(?<!"):
        pattern = pattern[pattern.index(")") + 1 :]
    return pattern[: pattern.rindex("(?!")] if pattern.endswith(")") and "(?!" in pattern else pattern


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def canonical(kind: Column, entity: Column) -> Column:
    """What different ways to write one entity, other than a name, have in common."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "ip6"), F.lower(entity))
        .otherwise(entity)
    )


def _noise(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that the key and parts decide, by HMAC-SHA512."""
    raw = key.encode("utf-8")
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in raw))
    message = F.encode(F.concat_ws("\x1f", *parts), "utf-8")
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 512))), 512)


def _digits(noise: Column) -> Column:
    return F.translate(noise, "abcdef", "052739")


def _letters(noise: Column) -> Column:
    return F.translate(noise, "0123456789", "ghkmnprtvz")


def _redraw(like: Column, noise: Column) -> Column:
    """Digits for digits, letters for letters, the rest as it is."""
    d, a = _digits(noise), _letters(noise)
    at = lambda s, i: F.substring(s, (i % 128) + 1, F.lit(1))
    return F.array_join(F.transform(F.split(like, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), at(d, i)).when(c.rlike(r"^\p{Ll}$"), at(a, i)).when(c.rlike(r"^\p{Lu}$"), F.upper(at(a, i))).otherwise(c)), "")


def _check_digit(body: Column) -> Column:
    """The Luhn digit that completes a string of digits."""
    twice = lambda c, i: F.when(i % 2 == 1, c).when(c > 4, 2 * c - 9).otherwise(2 * c)
    weighed = F.transform(F.transform(F.split(F.reverse(body), ""), lambda c: c.try_cast("int")), twice)
    return F.pmod(-F.aggregate(weighed, F.lit(0), lambda a, c: a + c), F.lit(10)).cast("string")


def _with_check(body: Column) -> Column:
    return F.concat(body, _check_digit(body))


def _luhn(number: Column) -> Column:
    return _with_check(F.substring(number, F.lit(1), F.length(number) - 1)) == number


# Syllables and first names of surrogates.
_SYLLABLES = {
    "latin": "ba del fi gar ho kem lu mir no pel ra sten to vin wa zor".split(),
    "cyrillic": "ба дел фи гар хо кем лу мир но пел ра стен то вин ва зор".split(),
    "greek": "βα δελ φι γαρ χο κεμ λου μιρ νο πελ ρα στεν το βιν σα ζορ".split(),
}
_FIRST = {
    "latin": {
        "f": "Anna Clara Elena Irene Julia Laura Maria Nora Olivia Paula Rosa Sara Teresa Vera Emma Lucia".split(),
        "m": "Adam Bruno David Erik Felix Hugo Ivan Jonas Leon Marco Oscar Paul Simon Tomas Victor Martin".split(),
    },
    "cyrillic": {
        "f": "Анна Вера Елена Ирина Мария Нина Ольга Раиса Софья Тамара Юлия Дарья Алла Лидия Зоя Инна".split(),
        "m": "Адам Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк Олег Павел Роман Семён Тимур Юрий".split(),
    },
    "greek": {
        "f": "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηλέκτρα Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Ξένια Ρέα Σοφία".split(),
        "m": "Αλέξης Βασίλης Γιώργος Δημήτρης Ευθύμης Ζήσης Ηλίας Θανάσης Ιάσονας Κώστας Λεωνίδας Μάρκος Νίκος Πέτρος Στέλιος Φώτης".split(),
    },
}


def _by_script(word: Column, of) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _name(kind: Column, canon: Column, noise: Column, attempt: Column) -> Column:
    """For a gender and a word: a first name of that gender, or a family name; a syllable more with each attempt."""
    gender, word = F.substring(canon, 1, 1), F.substring(canon, F.lit(3), F.length(canon))
    nibble = lambda i: F.conv(F.substring(noise, i, 1), 16, 10).cast("int")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), nibble(i) + 1)
    syllable = lambda parts: lambda h: F.element_at(F.array(*[F.lit(x) for x in parts]), F.conv(h, 16, 10).cast("int") + 1)
    more = lambda script: F.array_join(F.transform(F.split(F.substring(noise, F.lit(20), attempt), ""), syllable(_SYLLABLES[script])), "")
    family = lambda script: F.concat(F.initcap(F.concat(*[pick(_SYLLABLES[script], 5 + j) for j in range(4)])), more(script))
    of_gender = lambda first: F.when(gender == "f", pick(first["f"], 1)).when(gender == "m", pick(first["m"], 1)).otherwise(F.when(nibble(2) < 8, pick(first["f"], 1)).otherwise(pick(first["m"], 1)))
    given = lambda script: F.concat(of_gender(_FIRST[script]), more(script))
    return F.concat(F.substring(canon, 1, 2), F.when(kind == "given", _by_script(word, given)).otherwise(_by_script(word, family)))


def draw(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The candidate for an entity, in its canonical form."""
    noise = _noise(key, kind, canon, attempt.cast("string"))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    site = _letters(_noise(key, F.lit("domain"), domain))
    octet = lambda i: ((F.conv(F.substring(noise, i, 4), 16, 10).cast("int") % 254) + 1).cast("string")
    # A short local part has few forms; letters that later rounds add make room.
    more = F.substring(_letters(F.reverse(noise)), F.lit(1), F.greatest(attempt - 1, F.lit(0)))
    email = F.concat(_redraw(local, noise), more, F.lit("@"), F.substring(site, 1, 10), F.lit(".example.org"))
    longer = F.greatest(attempt - SAME_LENGTH + 1, F.lit(0))
    number = lambda size: F.concat(F.substring(canon, 1, 1), F.substring(_digits(noise), F.lit(1), size - 1))
    size = F.length(canon) + longer
    prefix = F.regexp_extract(canon, "^(AKIA|(?:sk|ghp|xoxb)[-_])?", 0)
    ip6 = F.concat(F.lit("2001:db8:"), F.concat_ws(":", *[F.substring(noise, 33 + 4 * i, 4) for i in range(6)]))
    return (
        F.when(kind == "email", email)
        .when((kind == "ip6") | ((kind == "ip") & (longer > 0)), ip6)
        .when(kind == "ip", F.concat_ws(".", octet(1), octet(9), octet(17), octet(25)))
        .when(kind == "phone", number(size))
        .when(kind == "card", F.when(_luhn(canon), _with_check(number(size - 1))).otherwise(number(size)))
        .when(kind == "ssn", F.substring(_digits(noise), F.lit(1), size))
        .when(kind.isin("name", "given"), _name(kind, canon, noise, attempt))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _redraw(F.substring(canon, F.lit(3), F.length(canon)), noise), F.substring(_digits(F.reverse(noise)), F.lit(1), longer)))
        .when(canon.rlike("^[0-9]{1,128}$"), F.substring(_digits(noise), F.lit(1), size))
        .when(canon.rlike("^[0-9a-f]{1,128}$"), F.substring(noise, F.lit(1), size))
        .when(canon.rlike("^[0-9A-F]{1,128}$"), F.upper(F.substring(noise, F.lit(1), size)))
        .otherwise(F.concat(prefix, F.substring(_redraw(canon, noise), F.length(prefix) + 1, F.length(canon)), F.substring(_letters(F.reverse(noise)), F.lit(1), longer)))
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon): distinct, and none of them an entity.

    Each round draws for what is left, gives a candidate that several drew to the first of them, and
    refuses those that are entities or taken. A round leaves few entities, so the rounds are few.
    """
    known = shared.written(entities.select("kind", "canon").distinct(), "entities")
    left, done = known, None
    for attempt in count():
        drawn = left.withColumn("surrogate", draw(F.col("kind"), F.col("canon"), F.lit(attempt), key))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = first.join(known.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = shared.written(good.select("kind", "canon", "surrogate"), "surrogates")
        done = good if done is None else done.unionByName(good)
        left = shared.written(left.join(good, ["kind", "canon"], "left_anti"), "left")
        if left.isEmpty():
            return done


def _render(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate in the layout and case of the entity as it stands."""
    before = lambda i, keep: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), keep, ""))
    dealt = lambda own, keep: F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(own), F.substring(surrogate, before(i, keep), F.lit(1))).otherwise(c)), "")
    upper = (entity == F.upper(entity)) & (entity != F.lower(entity))
    # A longer surrogate ends with what the layout has no place for.
    after = lambda other: F.substring(surrogate, F.length(F.regexp_replace(entity, other, "")) + 1, F.length(surrogate))
    word = F.substring(surrogate, F.lit(3), F.length(surrogate))
    return (
        F.when(kind.isin("card", "ssn", "phone"), F.concat(dealt("[0-9]", "[^0-9]"), after("[^0-9]")))
        .when(kind == "iban", F.concat(dealt("[0-9A-Z]", "[^0-9A-Z]"), after("[^0-9A-Z]")))
        .when(kind.isin("name", "given"), F.when(upper & (F.length(entity) > 1), F.upper(word)).otherwise(word))
        .otherwise(F.when(upper & kind.isin("email", "ip6"), F.upper(surrogate)).otherwise(surrogate))
    )


def _own_names(hits: Column) -> Column:
    """The full names and family names that a text gives a title, longest first."""
    titled = F.transform(F.filter(hits, lambda h: h.rlike(_TITLE)), lambda h: F.regexp_replace(h, _TITLE, ""))
    both = F.array_distinct(F.concat(titled, F.transform(titled, lambda n: F.substring_index(n, " ", -1))))
    both = F.filter(both, lambda n: F.length(n) >= 3)
    return F.reverse(F.array_sort(F.transform(both, lambda n: F.struct(F.length(n).alias("size"), n.alias("name")))))["name"]


def pseudonymised(docs: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """docs with surrogates in text and their number in _n_entities, and the table of entities.

    The patterns run over each text once; the rows with what they found there are a written table.
    """
    key = key or docs.sparkSession.conf.get("millrace.pii.key", None) or KEY
    columns = [c for c in docs.columns if c.lower() != "_n_entities"]
    found, digest, text, n = shared.fresh(docs, "_found", "_digest", "_text", "_n")
    with shared.scope() as tables:
        marked = docs.select(*columns, F.coalesce(detect(F.col("text")), F.array().cast("array<string>")).alias(found))
        marked = shared.written(marked.withColumn(digest, F.when(F.size(found) > 0, F.sha2("text", 256))), "marked")
        texts = marked.filter(F.size(found) > 0).groupBy(F.col(digest).alias("digest")).agg(F.first("text").alias("text"), F.first(found).alias("hits"))
        own = _own_names(F.col("hits"))
        texts = texts.withColumn("own", own)
        literal = F.array_join(F.transform("own", lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|")
        pattern = F.when(F.size("own") > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?:"), literal, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ANY))
        texts = texts.withColumn("pattern", pattern)
        texts = texts.withColumn("hits", F.when(F.size("own") > 0, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("hits")))
        texts = shared.written(texts, "texts")

        entity = F.col("entity")
        hits = texts.select("digest", "own", F.posexplode("hits").alias("pos", "entity"))
        kind = F.when(F.array_contains("own", entity), "name").otherwise(kind_of(entity))
        digits = F.regexp_replace(entity, "[^0-9]", "")
        # Other long numbers look like cards; such a hit stays as it is.
        kind = F.when((kind == "card") & ~(_luhn(digits) & digits.rlike("^[2-6]")), F.lit(None)).otherwise(kind)
        hits = shared.written(hits.select("digest", "pos", "entity", kind.alias("kind")), "hits")
        title = F.regexp_extract("entity", _TITLE, 0)
        words = F.split(F.regexp_replace("entity", _TITLE, ""), " ")
        names = hits.filter("kind = 'name'").select("digest", "pos", "entity", title.alias("title"), F.size(words).alias("size"), F.posexplode(words).alias("i", "word"))
        female, male = F.col("title").rlike(rf"^(?:{_FEMALE})\.? "), F.col("title").rlike(rf"^(?:{_MALE})\.? ")
        names = names.select("digest", "pos", "i", "word", F.when(F.col("i") == 0, F.col("title")).otherwise(F.lit(" ")).alias("before"), F.when((F.col("i") == 0) & (F.col("size") > 1), "given").otherwise("name").alias("kind"), _capital(F.col("word")).alias("capital"), female.cast("int").alias("f"), male.cast("int").alias("m"))
        gender = F.when(F.sum("f") > F.sum("m"), "f").when(F.sum("m") > F.sum("f"), "m").otherwise("n")
        genders = names.filter("kind = 'given'").groupBy("capital").agg(gender.alias("gender"))
        names = names.join(genders, "capital", "left").select("digest", "pos", "i", "before", F.col("word").alias("entity"), "kind", F.concat(F.when(F.col("kind") == "given", F.coalesce("gender", F.lit("n"))).otherwise(F.lit("n")), F.lit(":"), "capital").alias("canon"))
        others = hits.filter("kind is null or kind <> 'name'").select("digest", "pos", F.lit(0).alias("i"), F.lit("").alias("before"), "entity", "kind", canonical(F.col("kind"), entity).alias("canon"))
        parts = shared.written(names.unionByName(others), "parts")
        table = shared.written(surrogates(parts.filter("kind is not null"), key), "table")
        shown = F.concat("before", F.coalesce(_render(F.col("kind"), entity, F.col("surrogate")), entity))
        of_part = parts.join(table, ["kind", "canon"], "left").select("digest", "pos", "i", shown.alias("shown"), F.col("surrogate").isNotNull().cast("int").alias("n"))
        of_hit = of_part.groupBy("digest", "pos").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "shown")))["shown"], "").alias("shown"), F.max("n").alias("n"))
        # A text's own entities are gathered, as many as it holds; pieces and surrogates alternate.
        of_text = of_hit.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("pos", "shown"))).alias("shown"), F.sum("n").cast("int").alias("n"))
        pieces = F.split("text", F.col("pattern"), -1)
        put = F.zip_with(pieces, F.concat(F.col("shown.shown"), F.array(F.lit(""))), lambda p, s: F.concat(p, s))
        new = shared.written(texts.join(of_text, "digest").select(F.col("digest").alias(digest), F.array_join(put, "").alias(text), F.col("n").alias(n)), "new")
        tables.keep(marked, table, new)
    plain = marked.filter(F.size(found) == 0).select(*columns, F.lit(0).alias("_n_entities"))
    changed = marked.filter(F.size(found) > 0).drop(*[c for c in columns if c == "text"]).join(new, digest)
    changed = changed.select(*[F.col(text).alias("text") if c == "text" else F.col(c) for c in columns], F.col(n).alias("_n_entities"))
    return plain.unionByName(changed), table


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, _ = pseudonymised(documents)
    return out.select("doc_id", "text", F.col("_n_entities").alias("n_entities"))
