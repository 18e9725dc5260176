"""Personal data by candidate gradient boosting, as column expressions.

Base kinds (email, ip, card, phone) are matched by fixed patterns and checks. High-recall
generators propose further, possibly overlapping spans. Boosted trees (trained by Spark's own
GBTClassifier) see format and context features; they become one nested CASE expression, so scoring
needs no shuffle and no Python. A candidate is kept where its probability reaches its generator's
threshold and no base span overlaps it; of overlapping candidates the longest stays, then the one of
highest probability, then the first, then the first generator's.

There are no labelled spans, so the trees learn from planted ones: about PLANTS snippets of the
documents' own texts get a made-up span each, either personal data (keys of known and unknown forms,
web tokens, key headers, social security numbers, IBANs, dates of birth, numbers of documents) or
something that looks like it (chains of words, digests, dotted names, certificates, serial numbers,
other dates, numbers of a bad checksum or structure). What was planted is the label, for the
candidate of the generator that it was planted for, whatever its format check says; the check is a
feature among others. The held-out half has other words before the spans, other alphabets, vendors
and countries than the fitting half. Thresholds are the smallest that hold PRECISION on it; recall
counts every plant, also those that no generator proposed. A generator where no threshold holds
keeps candidates that pass its format check. Without documents nothing is trained.

Offsets are code points, end exclusive. Null texts are empty and have no spans. Repeated rows
are judged alike; an empty table gives an empty result. A long text is read whole: running sums
over its spans are taken in blocks, overlaps are looked for among neighbours only. Further columns
of docs, whatever their names, come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import packed

#: Planted spans that the trees learn from and are held against, and the snippets they stand in.
PLANTS, SNIPPET, PRECISION = 8_000, 48, 0.95
TREES, DEPTH = 12, 4
#: A threshold that no probability reaches.
NEVER = 2.0
CONTEXT = 32


def bound(value: Column, body) -> Column:
    """`body(value)` with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


# A match starts where a run of its first characters starts, or where the last match ended: the
# leftmost matches are the same as without this, in linear time. Possessive repeats never go back,
# which changes nothing as no repeat may end inside what follows it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """step over all values so far, for each value of an array of ints; in blocks of about its square root, as appending copies."""

    def within(block: Column, first: Column) -> Column:
        one = lambda a, x: bound(step(a["at"], x), lambda y: F.struct(y.alias("at"), F.concat(a["out"], F.array(y)).alias("out")))
        return F.aggregate(block, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), one)["out"]

    def blocks(side: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(values) - 1, side), lambda b: F.slice(values, b + 1, side))

    def placed(parts: Column) -> Column:
        # No value, then what each block comes to: the running value before block k stands at place k.
        before = F.concat(F.array(start), within(F.transform(parts, lambda x: F.aggregate(F.slice(x, 2, F.size(x)), x[0], step)), start))
        return bound(before, lambda b: F.flatten(F.transform(parts, lambda x, k: within(x, F.get(b, k)))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(bound(F.ceil(F.sqrt(F.size(values))).cast("int"), lambda side: bound(blocks(side), placed)))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s int, e int, m string, before string>> of the leftmost non-overlapping matches, with what stands before them from the last match on."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(m: Column, g: Column) -> Column:
        lengths = F.zip_with(m, F.slice(g, 1, F.size(m)), lambda x, y: F.length(x) + F.length(y))
        before = lambda i: F.right(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(g, i)), F.lit(CONTEXT))
        return bound(running(lengths, lambda a, x: a + x, F.lit(0)), lambda ends: F.transform(m, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("s"), F.get(ends, i).alias("e"), x.alias("m"), before(i).alias("before"))))

    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string>>")
    return bound(found, lambda m: F.when(F.size(m) == 0, none).otherwise(bound(gaps, lambda g: placed(m, g))))


def clusters(sorted_spans: Column) -> Column:
    """Spans in order of start, cut where none so far reaches the next."""

    def cut(ends: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(sorted_spans) - 1), lambda i: (i == 0) | (F.get(sorted_spans, i)["s"] >= F.get(ends, i - 1)))
        return bound(first, lambda f: F.transform(f, lambda a, k: F.slice(sorted_spans, a + 1, F.coalesce(F.get(f, k + 1), F.size(sorted_spans)) - a)))

    ends = running(F.transform(sorted_spans, lambda x: x["e"]), lambda a, x: F.greatest(a, x), F.lit(0))
    return F.when(F.size(sorted_spans) == 0, F.array()).otherwise(bound(ends, cut))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(F.split(F.reverse(d), ""), lambda x, i: value(F.coalesce(x.try_cast("int"), F.lit(0)), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])?"
IP_OK = rf"^{PART}(?:\.{PART}){{3}}$"
BASE = {
    "email": (EMAIL, "@", lambda m: F.lit(True)),
    "ip": (IP, None, lambda m: m.rlike(IP_OK)),
    "card": (CARD, None, lambda m: bound(digits(m), lambda d: F.length(d).between(14, 19) & luhn(d))),
    "phone": (PHONE, "+", lambda m: F.length(digits(m)).between(10, 15)),
}


@dataclass(frozen=True)
class Generator:
    """Proposes matches of `pattern`; `check` is its format check, of the match and what stands before it."""

    kind: str
    pattern: str
    check: Callable[[Column, Column], Column]
    hint: str


def remainder97(x: Column) -> Column:
    """The remainder of a string by 97, letters as 10 to 35."""
    step = lambda a, x: F.when(x.rlike("[0-9]"), a * 10 + F.ascii(x) - 48).otherwise(a * 100 + F.ascii(x) - 55) % 97
    return F.aggregate(F.split(x, ""), F.lit(0), step)


def mod97(m: Column) -> Column:
    """Whether an IBAN's check digits hold: its first four characters moved to the end give the remainder 1."""
    d = F.replace(m, F.lit(" "), F.lit(""))
    return F.length(d).between(15, 34) & (remainder97(F.concat(F.substring(d, 5, 64), F.substring(d, 1, 4))) == 1)


def iban_of(m: Column) -> Column:
    """The match without up to two last groups, which may be words after it: the longest whose check digits hold, or all."""
    shorter = F.regexp_replace(m, " [A-Z0-9]{1,4}$", "")
    shortest = F.regexp_replace(m, "(?: [A-Z0-9]{1,4}){1,2}$", "")
    return F.when(mod97(m), m).when(mod97(shorter), shorter).when(mod97(shortest), shortest).otherwise(m)


KEY = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^(?:ghp|gho|ghs)_[A-Za-z0-9]{36}$|^(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}$|^github_pat_[A-Za-z0-9_]{22,}$|^glpat-[A-Za-z0-9_-]{20,}$|^AIza[A-Za-z0-9_-]{35}$|^npm_[A-Za-z0-9]{36}$|^xox[bp]-[A-Za-z0-9-]{10,}$|^(?=[^A-Za-z]*[A-Za-z])(?=(?:[^0-9]*[0-9]){5})[a-z0-9]{24,}$"
#: A key of any alphabet where a word for secrets is assigned to: all of upper case, lower case and digits, three changes between letters and digits.
MIXED = r"^(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^0-9]*[0-9]).{20,}$"
CHANGE = "[A-Za-z][0-9]|[0-9][A-Za-z]"
ASSIGNED = "(?i)(?:key|token|secret|passw)[a-z_]*[\\x20\"']*[:=]+[\\x20\"']*$"

#: What announces a social security number of blanks, a date of birth, the number of a document.
SSN_BEFORE = "(?i)(?:ssn|social security)[^0-9]{0,12}$"
BORN_BEFORE = "(?i)(?:born|birth|birth ?date|birthday|dob)(?: on)?[\\x20:=-]*$"
DOCUMENT_BEFORE = "(?i)(?:passport|identity card|driv[a-z']* licen[cs]e)(?: no| number| nr)?[\\x20.:=#-]*$"

#: Proposals beyond the base kinds, each with a word list that often stands before it.
GENERATORS = (
    Generator("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+", lambda m, before: m.rlike(KEY) | (m.rlike(MIXED) & (F.regexp_count(m, F.lit(CHANGE)) >= 3) & before.rlike(ASSIGNED)), "(?i)(?:key|token|secret|passw)"),
    Generator("ssn", r"(?<![0-9-])[0-9]{3}([\x20-])[0-9]{2}\1[0-9]{4}(?![0-9-])", lambda m, before: m.rlike(r"^(?!000|666|9)[0-9]{3}[ -](?!00)[0-9]{2}[ -](?!0000)[0-9]{4}$") & (m.contains("-") | before.rlike(SSN_BEFORE)), "(?i)(?:ssn|social)"),
    Generator("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda m, before: mod97(m), "(?i)(?:iban|bank|konto)"),
    Generator("webtoken", r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{12,}+\.[A-Za-z0-9_-]{12,}+\.[A-Za-z0-9_-]{12,}+(?![.])", lambda m, before: m.rlike(r"^eyJ[^.]*\.eyJ"), "(?i)(?:token|bearer|authorization|jwt)"),
    Generator("privatekey", r"-----BEGIN [A-Z0-9 ]{3,40}-----(?:\s[A-Za-z0-9+/=\s]*+-----END [A-Z0-9 ]{3,40}-----)?", lambda m, before: m.rlike(r"^-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"), "(?i)key"),
    Generator("birthdate", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9/-])", lambda m, before: before.rlike(BORN_BEFORE), "(?i)(?:born|birth|dob)"),
    Generator("document", r"(?<![A-Za-z0-9.,:-])[A-Z]{0,2}[0-9]{6,9}[A-Z]?(?![A-Za-z0-9]|[.,:-][0-9])", lambda m, before: before.rlike(DOCUMENT_BEFORE), "(?i)(?:passport|identity card|driv)"),
)


def base_spans(text: Column) -> Column:
    """array<struct<s,e,kind,k>> of the base spans, by start, then kind."""

    def of(k: int, kind: str) -> Column:
        pattern, needs, ok = BASE[kind]
        found = F.filter(spans(text, pattern), lambda x: ok(x["m"]))
        full = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))
        none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
        hint = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
        return F.when(hint, full).otherwise(none)

    return F.sort_array(F.concat(*(of(k, kind) for k, kind in enumerate(BASE))))


FEATURES = ("kind", "length", "digits", "upper", "lower", "marks", "hint", "assigned", "switches", "check", "other")
#: Words before numbers and digests that are no personal data.
OTHER = "(?i)(?:commit|sha|md5|digest|checksum|revision|order|invoice|part|isbn|ref|file|path|serial|version)"


def proposals(text: Column) -> Column:
    """array<struct<s,k,e,kind,f array<double>>> of all generators' candidates with their features."""

    def share(m: Column, others: str) -> Column:
        return F.length(F.regexp_replace(m, others, "")).cast("double") / F.greatest(F.length(m), F.lit(1))

    def of(k: int, g: Generator) -> Column:
        def made(x: Column) -> Column:
            m = iban_of(x["m"]) if g.kind == "iban" else x["m"]
            return bound(m, lambda m: described(x["s"], m, x["before"]))

        def described(s: Column, m: Column, before: Column) -> Column:
            ok = F.coalesce(g.check(m, before), F.lit(False))
            f = F.array(
                F.lit(float(k)), F.length(m).cast("double"), share(m, "[^0-9]"), share(m, "[^A-Z]"), share(m, "[^a-z]"), share(m, "[A-Za-z0-9]"),
                before.rlike(g.hint).cast("double"), before.rlike("[:=][\\x20\"']*$").cast("double"),
                F.regexp_count(m, F.lit(CHANGE)).cast("double"), ok.cast("double"), before.rlike(OTHER).cast("double"),
            )
            return F.struct(s.alias("s"), F.lit(len(BASE) + k).alias("k"), (s + F.length(m)).alias("e"), F.lit(g.kind).alias("kind"), f.alias("f"))

        return F.transform(spans(text, g.pattern), made)

    return F.concat(*(of(k, g) for k, g in enumerate(GENERATORS)))


def tree_value(node, f: Column) -> Column:
    """One tree of a fitted model as a CASE expression over the features."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(f[split.featureIndex()] <= F.lit(float(split.threshold())), tree_value(node.leftChild(), f)).otherwise(tree_value(node.rightChild(), f))


@dataclass
class Model:
    trees: list
    weights: list[float]
    thresholds: tuple[float, ...] = ()
    #: Of each generator: threshold, precision and recall on the held-out plants.
    curve: tuple[tuple[tuple[float, float, float], ...], ...] = ()

    def probability(self, f: Column) -> Column:
        margin = sum((w * tree_value(t, f) for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def plants(docs: DataFrame, number: int = PLANTS) -> DataFrame:
    """text, s, e, kind, label, part: snippets of docs with a made-up span from s to e each; label 1 if it stands for personal data of the kind."""
    texts = docs.where(F.length("text") > 0)
    n = texts.count()
    some = texts.select("text", F.length("text").alias("n"), F.sha2("text", 256).alias("id")).sample(min(1.0, number / max(1, n)), seed=3)
    rows = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max(1, number // max(1, min(n, number)))))))
    rows = rows.withColumn("h", F.sha2(F.concat_ws(":", F.col("k").cast("string"), "id"), 512))
    # Snippets start anywhere in the text.
    place = F.conv(F.substring("h", 1, 12), 16, 10).cast("long") % F.greatest(F.col("n") - 2 * SNIPPET, F.lit(1))
    rows = rows.select("h", F.substring("text", place.cast("int") + 1, F.lit(400)).alias("piece"))
    number_of = lambda at, most: F.conv(F.substring("h", at, 7), 16, 10).cast("long") % most
    hexes = lambda at, size: F.substring("h", at, size)
    rows, part = rows.withColumn("part", number_of(120, 2)), F.col("part")
    #: What the fitting half has, and what the held-out half has instead.
    either = lambda fit, held: F.when(part == 0, fit).otherwise(held)
    one_of = lambda at, *values: F.get(F.array(*map(F.lit, values)), number_of(at, len(values)).cast("int"))
    words = lambda at, fit, held: either(one_of(at, *fit), one_of(at, *held))
    figures = "0123456789012345"
    written_in = lambda at, size, alphabet: F.translate(hexes(at, size), "0123456789abcdef", alphabet)
    spelled = lambda at, size, fit, held="": either(written_in(at, size, fit), written_in(at, size, held)) if held else written_in(at, size, fit)
    upper, mixed = ("A7QK2ZM9XB4TRV6J", "C3WN8YH5PD1SEL0G"), ("aB3dE5gH7jK9mN2p", "qR4sT6uV8wX0yZ1c")
    letters = F.regexp_replace("piece", r"[^A-Za-z]+", "")
    rows, chain = rows.withColumn("chain", F.concat(F.lower(letters), spelled(9, 18, "abcdefghijklmnop"))), F.col("chain")
    two = lambda at, most: F.lpad((1 + number_of(at, most)).cast("string"), 2, "0")
    ssn = F.concat_ws("-", F.lpad((1 + number_of(20, 665)).cast("string"), 3, "0"), two(30, 99), F.lpad((1 + number_of(40, 9999)).cast("string"), 4, "0"))
    no_ssn = F.concat(words(25, ("000", "666", "912"), ("987", "666", "934")), F.substring(ssn, 4, 8))
    rows, country = rows.withColumn("country", words(27, ("DE", "FR", "ES", "GB"), ("NL", "NO", "IT", "AT"))), F.col("country")
    letters4 = F.when(country.isin("GB", "NL"), spelled(33, 4, "ABCDEFGHIJKLMNOP")).otherwise("")
    rows, account = rows.withColumn("account", F.concat(letters4, F.substring(spelled(50, 23, figures), 1, (11 + number_of(44, 13)).cast("int")))), F.col("account")
    rows, check = rows.withColumn("check", 98 - remainder97(F.concat(account, country, F.lit("00")))), F.col("check")
    iban = F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)
    no_iban = F.concat(country, F.lpad(((check + 1 + number_of(60, 90)) % 97).cast("string"), 2, "0"), account)
    grouped = lambda x: F.when(number_of(70, 2) == 0, x).otherwise(F.trim(F.regexp_replace(x, "(.{4})", "$1 ")))
    year = (1930 + number_of(52, 90)).cast("string")
    mark = one_of(56, ".", "/")
    date = F.when(number_of(58, 2) == 0, F.concat_ws("-", year, two(62, 12), two(66, 28))).otherwise(F.concat(two(66, 28), mark, two(62, 12), mark, year))
    document = F.concat(one_of(57, "", "C", "X", "AB"), spelled(60, 7, figures), one_of(68, "", "", "P"))
    web = F.concat(F.lit("eyJ"), spelled(40, 17, *mixed), F.lit(".eyJ"), spelled(58, 24, *mixed), F.lit("."), spelled(84, 32, *mixed))
    dotted = F.concat_ws(".", F.substring(chain, 1, 13), F.substring(chain, 3, 14), F.substring(chain, 2, 12))
    block = lambda what: F.concat(F.lit("-----BEGIN "), what, F.lit("-----"))
    secret = (("key = \"", "secret: ", "token=", "api_key = '"), ("password: ", "access token = \"", "client_secret = ", "auth_token=\""))
    maybe_secret = (("", "", "key ", *secret[0]), ("", "", "with ", *secret[1]))
    other = (("commit ", "sha256 ", "md5 ", "file "), ("path ", "digest: ", "checksum: ", "revision "))
    numbers = (("order ", "part no ", "ref "), ("isbn ", "serial ", "invoice "))
    # (label, kind, words before it, span)
    kinds = (
        (1, "secret", words(80, *maybe_secret), F.concat(either(F.lit("AKIA"), F.lit("ASIA")), spelled(90, 16, *upper))),
        (1, "secret", words(80, *maybe_secret), F.concat(words(85, ("ghp_", "gho_"), ("ghs_", "npm_")), spelled(90, 36, *mixed))),
        (1, "secret", words(80, *maybe_secret), F.concat(words(85, ("sk_live_", "glpat-"), ("rk_test_", "github_pat_")), spelled(90, 24, *mixed))),
        (1, "secret", words(80, *maybe_secret), F.concat(F.lit("AIza"), spelled(84, 35, *mixed))),
        (1, "secret", words(80, *secret), hexes(88, 40)),
        (1, "secret", words(80, *secret), F.concat(spelled(86, 20, *mixed), one_of(84, "/", "+", "x"), spelled(108, 19, *mixed))),
        (1, "ssn", words(80, ("", "", "ssn ", "ssn: "), ("", "", "social security number ", "SSN ")), ssn),
        (1, "ssn", words(80, ("ssn ", "ssn: "), ("social security number ", "SSN ")), F.translate(ssn, "-", " ")),
        (1, "iban", words(80, ("", "", "iban "), ("", "", "iban: ", "bank account ")), grouped(iban)),
        (1, "webtoken", words(80, ("", "token=", "bearer "), ("", "authorization: ", "jwt ")), web),
        (1, "privatekey", words(80, ("", "key: ", "path "), ("", "file ")), block(words(85, ("RSA PRIVATE KEY", "PRIVATE KEY", "ENCRYPTED PRIVATE KEY"), ("OPENSSH PRIVATE KEY", "EC PRIVATE KEY")))),
        (1, "birthdate", words(80, ("born ", "date of birth: ", "dob "), ("born on ", "birth date ", "DOB: ")), date),
        (1, "document", words(80, ("passport no. ", "passport number: "), ("passport: ", "identity card no. ", "driving licence ")), document),
        (0, "secret", words(80, ("", "", "key ", *secret[0], *other[0]), ("", "", *secret[1], *other[1])), F.substring(chain, 1, (16 + number_of(83, 12)).cast("int"))),
        (0, "secret", words(80, ("", *other[0]), ("", *other[1])), F.concat(F.substring(chain, 1, 6), one_of(82, "/", "-", "_"), F.substring(chain, 7, 9), F.lit("-"), spelled(90, 4, figures))),
        (0, "secret", words(80, *other), hexes(88, 40)),
        (0, "secret", words(80, ("", *other[0]), ("", *other[1])), F.concat(spelled(86, 20, *mixed), one_of(84, "/", "+", "x"), spelled(108, 19, *mixed))),
        (0, "secret", words(80, ("", "", *numbers[0]), ("", "", *numbers[1])), spelled(90, 17, figures)),
        (0, "ssn", words(80, ("", "ssn ", *numbers[0]), ("", "SSN ", *numbers[1])), no_ssn),
        (0, "ssn", words(80, *numbers), F.when(number_of(70, 2) == 0, ssn).otherwise(F.translate(ssn, "-", " "))),
        (0, "iban", words(80, ("", "iban ", *numbers[0]), ("", "iban: ", *numbers[1])), grouped(no_iban)),
        (0, "webtoken", words(80, ("", "token=", *other[0]), ("", "module ", *other[1])), dotted),
        (0, "privatekey", words(80, ("", "key: ", "path "), ("", "file ")), block(words(85, ("CERTIFICATE", "RSA PUBLIC KEY", "X509 CRL", "PGP PUBLIC KEY BLOCK", "EC PUBLIC KEY", "NEW CERTIFICATE REQUEST"), ("PUBLIC KEY", "CERTIFICATE REQUEST")))),
        (0, "birthdate", words(80, ("", "on ", "published ", "order date "), ("", "due ", "since ", "in force from ")), date),
        (0, "document", words(80, ("", "over ", *numbers[0]), ("", "about ", *numbers[1])), document),
    )
    rows, kind = rows.withColumn("of", number_of(75, len(kinds)).cast("int")), F.col("of")
    made = F.coalesce(*(F.when(kind == i, F.struct(F.lit(y).alias("label"), F.lit(g).alias("kind"), w.alias("words"), x.alias("span"))) for i, (y, g, w, x) in enumerate(kinds)))
    snippet = F.translate("piece", "\n", " ")
    rows = rows.select(F.substring(snippet, 1, SNIPPET).alias("left"), F.substring(snippet, SNIPPET + 1, SNIPPET).alias("right"), made.alias("made"), "part")
    before = F.concat("left", F.lit(" "), "made.words")
    closing = F.when(F.col("made.words").endswith('"'), '"').when(F.col("made.words").endswith("'"), "'").otherwise("")
    return rows.select(
        F.concat(before, "made.span", closing, F.lit(" "), "right").alias("text"), F.length(before).alias("s"), (F.length(before) + F.length("made.span")).alias("e"),
        "made.kind", F.col("made.label").cast("double").alias("label"), "part",
    )


def train(docs: DataFrame) -> Model | None:
    """Fit on one half of the plants, thresholds by the other; None without documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    planted = plants(docs).persist()
    rows = planted.withColumn("c", F.explode(proposals(F.col("text")))).where("c.s = s AND c.e = e")
    label = F.when(F.col("c.kind") == F.col("kind"), F.col("label")).otherwise(0.0)
    rows = rows.select("c.f", "c.k", label.alias("label"), "part", array_to_vector("c.f").alias("features")).persist()
    try:
        fitting = rows.where("part = 0")
        if fitting.select("label").distinct().count() < 2:
            return None
        got = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=1, minInstancesPerNode=5).fit(fitting)
        model = Model([t._call_java("rootNode") for t in got.trees], [float(w) for w in got.treeWeights])
        grid = [x / 20 for x in range(10, 20)]
        held = rows.where("part = 1").withColumn("p", model.probability(F.col("f")))
        true, asked = (lambda t: F.sum(F.when(F.col("p") >= t, F.col("label")))), (lambda t: F.count_if(F.col("p") >= t))
        sums = held.groupBy("k").agg(*(x.alias(f"{n}{i}") for i, t in enumerate(grid) for n, x in (("true", true(t)), ("asked", asked(t)))))
        by = {r["k"]: r for r in sums.collect()}  # a row a generator
        due = {r["kind"]: r["n"] for r in planted.where("part = 1").groupBy("kind").agg(F.sum("label").alias("n")).collect()}
        share = lambda a, b: (a or 0) / b if b else 0.0
        curves = [tuple((t, share(r[f"true{i}"], r[f"asked{i}"]), share(r[f"true{i}"], due.get(g.kind))) for i, t in enumerate(grid)) if r else () for g, r in ((g, by.get(len(BASE) + k)) for k, g in enumerate(GENERATORS))]
        model.curve = tuple(curves)
        model.thresholds = tuple(next((t for t, precision, _ in c if precision >= PRECISION), NEVER) for c in curves)
        return model
    finally:
        rows.unpersist()
        planted.unpersist()


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def added(base: Column, candidates: Column, model: Model | None) -> Column:
    """Candidates above their thresholds that overlap no base span and no better candidate."""
    limits = F.array(*(F.lit(model.thresholds[k] if model else NEVER) for k in range(len(GENERATORS))))
    passes = lambda c: c["f"][FEATURES.index("check")] > 0
    chance = lambda c: model.probability(c["f"]) if model else passes(c).cast("double")
    rated = F.transform(candidates, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), c["kind"].alias("kind"), chance(c).alias("p"), passes(c).alias("ok")))
    limit = lambda c: F.get(limits, c["k"] - len(BASE))
    good = F.filter(rated, lambda c: (c["p"] >= limit(c)) | (c["ok"] & (limit(c) == NEVER)))
    fixed = F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["k"].alias("k"), b["kind"].alias("kind"), F.lit(NEVER).alias("p"), F.lit(True).alias("ok")))
    size = lambda a: a["e"] - a["s"]
    better = lambda a, b: (size(a) > size(b)) | ((size(a) == size(b)) & ((a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["s"] < b["s"]) | ((a["s"] == b["s"]) & (a["k"] < b["k"]))))))
    best = lambda g: F.filter(g, lambda c: (c["k"] >= len(BASE)) & ~F.exists(g, lambda o: overlaps(o, c) & better(o, c)))
    kept = lambda g: F.flatten(F.transform(clusters(g), best))
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    out = lambda x: F.transform(bound(F.sort_array(F.concat(fixed, x)), kept), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["kind"].alias("kind")))
    return bound(good, lambda x: F.when(F.size(x) == 0, none).otherwise(out(x)))


def found(docs: DataFrame) -> DataFrame:
    """row, the columns of docs, with text and the arrays base and all_spans."""
    model = train(docs.select("text"))
    text = F.coalesce("text", F.lit(""))
    rows = packed(docs, F.col("text"), F.explode(F.array(F.struct(base_spans(text).alias("b"), proposals(text).alias("c")))).alias("x"))
    rows = rows.select("row", "text", F.col("x.b").alias("base"), F.explode(F.array(added(F.col("x.b"), F.col("x.c"), model))).alias("added"))
    return rows.select("row", "text", "base", F.sort_array(F.concat("base", "added")).alias("all_spans"))


def written(some: Column) -> Column:
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def is_kind(kind: str):
    return lambda x: x["kind"] == kind


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text)."""
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found(docs.select("doc_id", "text")).select("row.doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"))


def pieces(text: Column, block: int = 1024) -> Callable[[Column, Column], Column]:
    """Substrings by code points from a start to an end, read from blocks of the text, so that none walks the text from its first byte."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    def piece(b: Column, s: Column, e: Column) -> Column:
        part = lambda k: F.substring(F.get(b, k), F.greatest(s - k * block, F.lit(0)) + 1, F.least(e - k * block, F.lit(block)) - F.greatest(s - k * block, F.lit(0)))
        return F.when(s >= e, "").otherwise(F.array_join(F.transform(F.sequence(F.floor(s / block).cast("int"), F.floor((e - 1) / block).cast("int")), part), ""))

    return lambda body: bound(blocks, lambda b: body(lambda s, e: piece(b, s, e)))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    runs = F.transform(clusters(F.col("all_spans")), lambda c: F.struct(c[0]["s"].alias("s"), F.array_max(F.transform(c, lambda x: x["e"])).alias("e"), c[0]["kind"].alias("kind")))

    def text(of: Callable[[Column, Column], Column]) -> Column:
        ends = lambda r, i: F.coalesce(F.get(r, i)["e"], F.lit(0))
        return bound(runs, lambda r: F.concat(F.array_join(F.transform(r, lambda x, i: F.concat(of(ends(r, i - 1), x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), ""), of(ends(r, F.size(r) - 1), F.length("text"))))

    rows = found(docs).withColumn("made", F.when(F.size("all_spans") > 0, pieces(F.col("text"))(text)).otherwise(F.col("text")))
    return rows.select(*(F.col("made").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
