"""Secret scan: candidates by pattern, false positives removed by a random forest.

DataFrame and Spark ML functions only. A candidate is the value of a name such as token or
password (4 characters or more), the password of a URL, or a run of 16 or more key-like
characters with a digit; a name before "=" is no part of it. Its features: length, character
classes and transitions between them, distinct characters, how much of it dictionary words
cover, whether it stands in a path, URL, quotes or assignment, and how often its neighbouring
words stand by labelled secrets.

The forest learns from labelled findings. Where none are given, ``planted_findings`` makes
them: values of known kind, secrets and look-alikes, each set between words of a document,
so a label comes from how a value was made, never from a pattern over its surroundings.
Names of secrets stand before look-alikes too, and secrets stand without names.

Texts are split once where candidates stand, and what features read of the text between two
candidates is taken there, from all of it; after that only candidates move. The dictionary is
counted over all documents and joined by a shuffle, whatever its size.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, row_key, saved

#: Names that secrets are assigned to, with a number after them or not, in any case.
_NAME = r"(?i:token|secret|key|passw[a-z]{0,20}|passphrase|pwd|auth|bearer|credential|(?<![a-z])(?:pw|pass))s?[_-]?[0-9]{0,3}"
_SIGN = r"(?::=|=>|[=:])"
#: Key-like characters; "=" joins a name to a value or pads a value.
_RUN, _JOINED = "A-Za-z0-9_+/.-", "A-Za-z0-9_+/=.-"


def _named(quote: str) -> str:
    """Stands behind a name, a sign and ``quote``; the first two only make it cheap."""
    return rf"""(?<=[=:>\s"'`])(?<=[=:>][ \t]{{0,8}}{quote})(?<={_NAME}["']?[ \t]{{0,8}}{_SIGN}[ \t]{{0,8}}{quote})"""


#: The first that fits at a place:
CANDIDATE = "|".join([
    # the quoted value of a name, with any characters
    _named('"') + r'[^"\r\n]{4,200}(?=")', _named("'") + r"[^'\r\n]{4,200}(?=')",
    # its bare value, up to white space, a quote or the next parameter of a URL
    _named("[\"'`]?") + r"""[^\s"'`=>:<,;](?:(?!&[A-Za-z0-9_.%-]{1,40}=)[^\s"'`<>]){3,}(?<![,;.:)\]}])""",
    # the password of a URL
    r"""(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/"'`<>]+(?=@)""",
    # at least 16 key-like characters, a digit among them, unless a value in them stands for itself
    rf"""(?<![{_JOINED}])(?=[A-Za-z_+/=.-]*[0-9])(?![{_JOINED}]*(?:=(?=[A-Za-z_+/.-]*[0-9])[{_RUN}]{{16}}|{_NAME}=[^\s"'`]{{4}}))[{_JOINED}]{{16,}}""",
    rf"""(?<![{_RUN}])(?=[A-Za-z_+/.-]*[0-9])[{_RUN}]{{16,}}(?:=+(?![^\s"'`,;)]))?""",
])
#: What a rule without learning would call a secret, for comparison: what is assigned to a name.
ASSIGNED = rf"""{_NAME}["']?\s*{_SIGN}\s*["'`]?$"""
_LETTER = r"0-9A-Za-z\x{80}-\x{10FFFF}"
#: Patterns of what stands before and after; possessive, so that long texts take linear time.
_LAST_WORD = rf"(?<![{_LETTER}])([{_LETTER}]++)[^{_LETTER}]*+\z"
_FIRST_WORD = rf"\A[^{_LETTER}]*+([{_LETTER}]++)"
_TAIL = r"(?<!\S)\S*+\z"

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "changes", "distinct", "hex", "covered",
    "slashes", "dots", "in_path", "in_url", "assigned", "quoted", "before_odds", "after_odds",
]


def find_candidates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, row, start, finding, before_word, after_word,
    in_path, in_url, assigned, quoted): start in code points from 0; what stands before and
    after reaches to the next candidate or the text's end. Rows that repeat doc_id and text
    are scanned once; null and empty texts have none. Texts may be of any length."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.regexp_like("text", F.lit(CANDIDATE)))
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    # piece i stands before finding i; the last piece stands after the last finding
    zipped = F.arrays_zip(F.split("text", CANDIDATE, -1).alias("piece"), found.alias("finding"))
    parts = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(zipped).alias("i", "p"))
    piece, yes = F.col("p.piece"), lambda c: c.cast("double")
    parts = parts.select("doc_id", "row", "i", "p.finding", piece.alias("piece"), F.regexp_extract(piece, _TAIL, 0).alias("tail")).select(
        "doc_id", "row", "i", "finding", F.length("piece").alias("n_piece"), F.coalesce(F.length("finding"), F.lit(0)).alias("n_finding"),
        ascii_lower(F.regexp_extract("piece", _LAST_WORD, 1)).alias("before_word"), ascii_lower(F.regexp_extract("piece", _FIRST_WORD, 1)).alias("first_word"),
        yes(F.regexp_like("tail", F.lit(r"[/\\]"))).alias("in_path"), yes(F.regexp_like("tail", F.lit(r"://|www\.|@"))).alias("in_url"),
        yes(F.regexp_like("piece", F.lit(r"""(?:=>|[=:])\s*+["'`]?\z"""))).alias("assigned"), yes(F.right("piece", F.lit(1)).isin('"', "'", "`")).alias("quoted"),
    ).distinct()
    inside = Window.partitionBy("row").orderBy("i")
    upto = F.sum(F.col("n_piece") + F.col("n_finding")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("start", upto - F.col("n_finding")).withColumn("after_word", F.coalesce(F.lead("first_word").over(inside), F.lit("")))
    return parts.where("finding is not null").select("doc_id", "row", "start", "finding", "before_word", "after_word", "in_path", "in_url", "assigned", "quoted")


def dictionary(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """The words of 4 to 12 letters a-z that at least ``min_docs`` documents hold: (word).
    Counted over all documents."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = "".join(chr(i) for i in range(128) if not chr(i).isalpha())
    plain = F.translate("text", letters + other, letters.lower() + " " * len(other))
    each = docs.where("text is not null").select(F.explode(F.array_distinct(F.split(plain, " "))).alias("word"))
    return each.where(F.regexp_like("word", F.lit(r"\A[a-z]{4,12}\z"))).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("word")


def _share(pattern: str) -> Column:
    return F.regexp_count("finding", F.lit(pattern)) / F.length("finding")


def with_features(findings: DataFrame, known_words: DataFrame) -> DataFrame:
    """The features that need no labels, and the neighbouring words. Words inside a
    finding are its runs of letters, cut where a capital starts one; each counts once for
    each time it stands there, so the work grows with the finding's length."""
    runs = F.regexp_extract_all("finding", F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+"), F.lit(0))
    inside = findings.select("row", "start", F.explode(F.filter(F.transform(runs, ascii_lower), lambda x: F.length(x).between(4, 12))).alias("word"))
    counted = inside.groupBy("row", "start", "word").agg(F.count(F.lit(1)).alias("times"))
    covered = counted.join(known_words, "word").groupBy("row", "start").agg(F.sum(F.col("times") * F.length("word")).alias("letters"))
    return findings.join(covered, ["row", "start"], "left").select(
        "doc_id", "row", "start", "finding",
        F.length("finding").cast("double").alias("length"),
        _share("[0-9]").alias("digits"), _share("[A-Z]").alias("uppers"), _share("[a-z]").alias("lowers"), _share("[^0-9A-Za-z]").alias("others"),
        _share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])").alias("changes"),
        (F.size(F.array_distinct(F.split("finding", ""))) / F.length("finding")).alias("distinct"),
        F.regexp_like("finding", F.lit(r"\A[0-9a-fA-F]+\z")).cast("double").alias("hex"),
        F.coalesce(F.col("letters") / F.length("finding"), F.lit(0.0)).alias("covered"),
        F.regexp_count("finding", F.lit("/")).cast("double").alias("slashes"),
        F.regexp_count("finding", F.lit(r"\.")).cast("double").alias("dots"),
        "in_path", "in_url", "assigned", "quoted", "before_word", "after_word",
    )


# --- labelled findings -------------------------------------------------------------------

_SECRET_NAMES = ("token", "api_key", "secret", "password", "auth_token", "CLIENT_SECRET", "DB_PASSWORD", "access_key")
_OTHER_NAMES = ("id", "version", "commit", "checksum", "sha1", "ref", "etag", "build")


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / float(1 << 53)


def planted_findings(docs: DataFrame, findings: int = 8_000, seed: int = 7) -> DataFrame:
    """Labelled findings: (doc_id, text, start, length, secret). Each is a value of a known
    kind between words of a document, as a text of its own.

    Some ``findings`` of them (the bound of what is learned from): documents are taken by a
    hash of doc_id, several values each where there are few. Kinds and values follow from
    hashes too, so reruns agree. Documents without a word, and null ids, take no part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").where(F.regexp_like("text", F.lit("[A-Za-z]{3}")))
    n = rows.count()
    each = max(1, min(50, findings // max(1, n)))
    rows = rows.where(_uniform(F.col("doc_id"), F.lit(seed)) < findings / max(1, n * each)).select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(each))))

    def pick(salt: int, n: Column | int) -> Column:
        return F.pmod(F.xxhash64("doc_id", "k", F.lit(seed), F.lit(salt)), F.lit(n) if isinstance(n, int) else n).cast("int")

    def one_of(salt: int, values: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), pick(salt, len(values)) + 1)

    def word(salt: int) -> Column:
        return ascii_lower(F.element_at("w", pick(salt, F.size("w")) + 1))

    def near(salt: int) -> Column:
        return F.array_join(F.slice("w", pick(salt, F.size("w")) + 1, 8), " ")

    digest = lambda salt: F.sha2(F.concat_ws("-", "doc_id", "k", F.lit(seed + salt)), 256)
    # what values are made of, as columns of a small written table: 40 letters and digits, hex digits, words
    parts = {f"w{i}": word(40 + i) for i in range(8)} | {f"n{i}": pick(50 + i, 90).cast("string") for i in range(3)}
    parts |= {f"mixed{i}": F.translate(F.base64(F.unhex(F.concat(digest(10 + i), digest(15 + i)))), "+/=\r\n", "") for i in range(2)} | {f"hex{i}": digest(20 + i) for i in range(3)}
    parts |= {"name": one_of(30, _SECRET_NAMES), "other": one_of(31, _OTHER_NAMES), "sign": one_of(32, ("=", " = ", ": ", ":")), "quote": one_of(33, ('"', "'")), "end": one_of(34, ("!", "$", "#", "&x", "-Q")), "size": pick(35, 16)}
    rows = saved(rows.select("doc_id", "k", *[c.alias(n) for n, c in parts.items()], F.concat(near(73), F.lit(" ")).alias("lead"), near(74).alias("rest")), "planted-parts")
    name, other, sign, quote, none = F.col("name"), F.col("other"), F.col("sign"), F.col("quote"), F.lit("")
    hexes = lambda i, n: F.left(f"hex{i}", F.lit(n))
    mixed = lambda i, least: F.left(f"mixed{i}", F.lit(least) + F.col("size"))
    phrase = lambda mark: F.concat_ws(mark, "w0", "w1", "w2", "n0")
    digits = lambda i, n: F.lpad(F.conv(hexes(i, 15), 16, 10), n, "7")
    kinds = [  # secret, what stands before, value, what stands after
        (True, F.concat(name, sign, quote), hexes(0, 32), quote),
        (True, F.concat(name, F.lit(" = "), quote), hexes(0, 32), quote),
        (True, F.concat(name, F.lit("=")), mixed(0, 16), none),
        (True, F.concat(name, F.lit(": "), quote), mixed(1, 20), quote),
        (True, F.lit("https://app:"), mixed(0, 8), F.lit("@db.example.org/main")),
        (True, F.concat(F.lit("https://example.org/?"), name, F.lit("=")), mixed(1, 16), F.lit("&page=2")),
        (True, F.lit("Authorization: Bearer "), mixed(0, 24), none),
        (True, F.lit("use "), F.concat(F.lit("ghp_"), mixed(1, 20)), none),
        (True, F.lit("account AK"), F.translate(hexes(1, 20), "0123456789abcdef", "Q2W3E4R5T6Y7UZIB"), none),
        (True, F.concat(name, sign, quote), F.concat(F.initcap(F.left("w3", F.lit(7))), "n1", "n2", "end"), quote),
        (False, F.concat(name, sign, quote), phrase("_"), quote),
        (False, F.concat(name, F.lit(" = ")), F.concat(F.lit("get_"), phrase("_"), F.lit("()")), none),
        (False, F.concat(F.lit("the "), name, F.lit(": ")), F.col("w4"), none),
        (False, F.concat(name, sign, quote), F.concat(F.lit("/etc/"), phrase("/"), F.lit(".pem")), quote),
        (False, F.lit("see /srv/"), F.concat(phrase("/"), F.lit(".txt")), none),
        (False, F.concat(other, F.lit(" ")), hexes(2, 40), none),
        (False, F.concat(other, sign, quote), hexes(2, 32), quote),
        (False, F.concat(other, F.lit(": ")), digits(1, 16), none),
        (False, F.lit("on "), F.concat(F.lit("2024-01-15T10:"), "n1", F.lit(":00.000")), none),
        (False, F.concat(other, F.lit(" ")), F.regexp_replace(hexes(2, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), none),
        (False, F.lit("https://example.org/"), F.concat(phrase("-"), F.lit("-"), digits(1, 8)), none),
        (False, F.lit("call "), F.concat("w5", F.initcap("w6"), F.initcap("w7"), "n2"), none),
        (False, F.concat(name, sign), digits(1, 6), none),
    ]
    forms = F.array(*[F.struct(F.lit(secret).alias("secret"), before.alias("before"), value.alias("value"), after.alias("after")) for secret, before, value, after in kinds])
    # secrets and look-alikes in equal number
    yes = sum(k[0] for k in kinds)
    kind = F.when(pick(70, 2) == 0, pick(71, yes)).otherwise(pick(72, len(kinds) - yes) + yes)
    rows = rows.select("doc_id", "lead", F.element_at(forms, kind + 1).alias("f"), "rest")
    text = F.concat("lead", "f.before", "f.value", "f.after", F.lit(" "), "rest")
    return rows.select("doc_id", text.alias("text"), (F.length("lead") + F.length("f.before")).cast("long").alias("start"), F.length("f.value").cast("long").alias("length"), "f.secret")


def labelled_candidates(planted: DataFrame, known_words: DataFrame) -> DataFrame:
    """The candidates found in planted texts that overlap the planted value, with features
    and ``secret``. Other candidates, out of the documents' own words, have no label."""
    key = row_key(F.col("doc_id"), F.col("text"))
    spans = planted.select(key.alias("row"), F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("to"), "secret").distinct()
    found = with_features(find_candidates(planted), known_words).join(spans, "row")
    return found.where((F.col("start") < F.col("to")) & (F.col("start") + F.col("length") > F.col("from"))).drop("from", "to")


# --- forest ------------------------------------------------------------------------------


def _odds(labelled: DataFrame, word: str, name: str) -> DataFrame:
    """Log odds of a secret by a neighbouring word; words seen less than 20 times are left
    to the default 0. One row for each word of the labelled findings, which are bounded."""
    secret = F.sum(F.col("secret").cast("int"))
    n = F.count(F.lit(1))
    return labelled.groupBy(word).agg(F.log((secret + 0.5) / (n - secret + 0.5)).alias(name), n.alias("seen")).where("seen >= 20").drop("seen")


class SecretForest:
    """A trained forest with the neighbour tables it was trained on."""

    def __init__(self, model: RandomForestClassificationModel | float, before: DataFrame, after: DataFrame):
        self.model, self.before, self.after = model, before, after

    def prepared(self, featured: DataFrame) -> DataFrame:
        rows = featured.join(self.before, "before_word", "left").join(self.after, "after_word", "left").fillna(0.0, ["before_odds", "after_odds"])
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)

    def score(self, featured: DataFrame) -> DataFrame:
        """``featured`` rows with score, the forest's probability of a secret."""
        rows = self.prepared(featured)
        if isinstance(self.model, float):
            return rows.withColumn("score", F.lit(self.model))
        return self.model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def train(labelled: DataFrame, sample: int = 20_000, trees: int = 30, depth: int = 8, seed: int = 7) -> SecretForest:
    """A forest from featured findings with a boolean ``secret``. It is fitted on a
    hashed sample of about ``sample`` findings; neighbour odds count all of them. If
    the labels have one value only, every score is that value."""
    labelled = saved(labelled, "labelled")
    before, after = (broadcast_if_small(saved(_odds(labelled, f"{x}_word", f"{x}_odds"), f"{x}-odds"), F.octet_length(f"{x}_word") + 64) for x in ("before", "after"))
    n, secrets = labelled.agg(F.count(F.lit(1)), F.sum(F.col("secret").cast("int"))).first()
    if not n or secrets in (0, n):
        return SecretForest(float(bool(n and secrets)), before, after)
    some = SecretForest(0.0, before, after).prepared(labelled.where(_uniform(F.col("row"), F.col("start"), F.lit(seed)) < sample / n))
    # a fixed order and partitioning, so that reruns fit the same trees
    rows = saved(some.select(F.col("secret").cast("double").alias("label"), "features", "row", "start").repartition(8, "row", "start").sortWithinPartitions("row", "start"), "findings")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return SecretForest(forest.fit(rows), before, after)


def scan(docs: DataFrame, labels: DataFrame | None = None, held_out: int = 2, threshold: float = 0.5, findings: int = 8_000) -> DataFrame:
    """One row per candidate of ``docs(doc_id, text)``: doc_id, start, length, score,
    is_secret (score over the threshold).

    ``labels(doc_id, start, secret)`` are labelled findings of these documents. Without
    them the forest learns from some ``findings`` planted ones. Only documents whose crc32 of
    doc_id modulo 4 is not ``held_out`` are learned from; null ids are not learned from.
    Rows that repeat doc_id and text are one; null, empty and blank texts have no candidate,
    and no candidates give an empty result. Texts and candidates may be of any length.
    Further columns are ignored, whatever their names.
    """
    known = saved(dictionary(docs), "dictionary")
    featured = saved(with_features(saved(find_candidates(docs), "candidates"), known), "features")
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != held_out
    if labels is None:
        planted = saved(planted_findings(docs.where(learned), findings), "planted")
        labelled = labelled_candidates(planted, known)
    else:
        given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("secret").cast("boolean").alias("secret"))
        labelled = featured.where(learned).join(given.where("secret is not null").distinct(), ["doc_id", "start"])
    scored = train(labelled).score(featured)
    return scored.select("doc_id", "start", F.length("finding").alias("length"), F.round("score", 6).alias("score"), (F.col("score") > threshold).alias("is_secret"))
