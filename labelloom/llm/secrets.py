"""Operator 1, secret scans: a random forest tells secrets from look-alikes among candidate strings.

Native: DataFrame functions and the JVM's MLlib. A candidate is a run of at least ``LEAST`` characters of the
usual alphabets in a word of the text, or of at least ``ASSIGNED`` behind a credential's name; a word can hold several.
Its features are its length, the transitions between kinds of characters, how much of its letters the corpus's own
frequent words and pieces of words cover, the shares of its characters, whether it is a path or address, and the
words beside it. The forest is trained on labelled findings, a bounded sample of them, and removes the false positives.

No table of labelled findings comes with the corpus. ``labelled_findings`` makes them from two places. Candidates of the
corpus are labelled only where their form or place leaves no doubt: formats that issuers publish and values given to a
credential's name are findings; addresses, paths, digests behind a word for one, names made of words, integrity digests and
embedded data are not, whatever name stands beside them; all others train nothing. Forms that the corpus lacks, hard
ones on both sides among them, come from ``example_findings``, lines that Spark derives from hashes. Part of the rows
train a second time without what stands beside the value, so that trees have to tell a value by itself too. A caller with
reviewed findings passes them instead.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written

LEAST, ASSIGNED, TRAIN_ROWS, EXAMPLES, TREES, DEPTH, SEED = 16, 8, 20_000, 3_000, 32, 9, 3
#: How many of the corpus's most frequent words and 4-letter pieces of words make the dictionary.
WORDS, PIECES = 1_000, 1_500
RUN = r"[A-Za-z0-9+/_=.-]{16,}"
SHORT_RUN = r"[A-Za-z0-9+/_=.-]{8,}"
#: A run with what stands before it and the signs behind it: the pieces of a word never overlap, so they stay as long as the word.
PIECE = r"(?s)\G.*?[A-Za-z0-9+/_=.-]{%d,}[^A-Za-z0-9+/_=.-]*"
#: Words beside a candidate that speak for or against a credential.
NAMES = ("token", "secret", "key", "apikey", "password", "passwd", "pwd", "credential", "credentials", "bearer", "auth", "authorization")
AGAINST = ("commit", "sha1", "sha256", "sha384", "sha512", "md5", "checksum", "digest", "hash", "uuid", "guid", "version", "rev", "revision", "etag", "see", "from", "mail", "email", "integrity", "base64", "image", "src", "href", "cache")
#: Formats of credentials that their issuers publish.
ISSUED = (r"^(AKIA|ASIA)[A-Z0-9]{16,20}$", r"^gh[pousr]_[A-Za-z0-9]{30,}$", r"^github_pat_[A-Za-z0-9_]{22,}$", r"^eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$", r"^xox[abprs]-[A-Za-z0-9-]{20,}$", r"^sk_(live|test)_[A-Za-z0-9]{16,}$", r"^glpat-[A-Za-z0-9_-]{20,}$")

#: What a value's surroundings tell; hidden from a row that trains a second time.
CONTEXT = ("path", "mail", "named", "against", "quoted", "assigned")
#: One row in so many trains a second time without its surroundings, unless they alone tell what it is.
HIDDEN = 3
FEATURES = ["length", "transitions", "lower_digit", "lower_upper", "digit_share", "upper_share", "hex_share", "distinct_share", "dictionary", "longest_letters", "dashes", "dots", "slashes", "word_share", "path", "mail", "named", "against", "quoted", "assigned"]


def _named(x: Column, names: tuple[str, ...]) -> Column:
    """Whether one of the names stands in a text, alone or as a part that signs or a capital set off."""
    return F.lower(F.regexp_replace(x, "([a-z])([A-Z])", "$1_$2")).rlike(r"(?<![a-z0-9])(" + "|".join(names) + r")(?![a-z0-9])")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, at (the word's place), run (its place in the word), value, word (its piece of it), before, before2, after of every candidate in the whole texts."""
    words = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    near = lambda w, i: F.coalesce(F.get(w, i), F.lit(""))
    looks = lambda x: (F.length(x) >= LEAST) & x.rlike(RUN)
    # A shorter value counts behind an assignment: name = value, name: value, or name=value in one word.
    given = lambda w, x, i: (F.length(x) >= ASSIGNED) & x.rlike(SHORT_RUN) & ((near(w, i - 1).rlike("[=:]$") & _named(F.concat_ws(" ", near(w, i - 2), near(w, i - 1)), NAMES)) | (x.rlike("[=:].") & _named(x, NAMES)))
    found = let(words, lambda w: F.transform(F.filter(F.transform(w, lambda x, i: F.when(looks(x) | given(w, x, i), i)), lambda i: i.isNotNull()), lambda i: F.struct(i.alias("at"), F.get(w, i).alias("word"), near(w, i - 1).alias("before"), near(w, i - 2).alias("before2"), near(w, i + 1).alias("after"))))
    rows = docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")
    pieces = F.when(F.col("word").rlike(RUN), F.regexp_extract_all("word", F.lit(PIECE % LEAST), F.lit(0))).otherwise(F.regexp_extract_all("word", F.lit(PIECE % ASSIGNED), F.lit(0)))
    rows = rows.select("doc_id", "at", "before", "before2", "after", F.posexplode(pieces).alias("run", "word"))
    value = F.when(F.col("word").rlike(RUN), F.regexp_extract("word", RUN, 0)).otherwise(F.regexp_extract("word", SHORT_RUN, 0))
    # name=value is one run: the value is what stands behind the sign.
    return rows.withColumn("value", F.regexp_replace(value, r"^[A-Za-z_.-]+=(?=[^=]{8})", ""))


class Dictionary:
    """The corpus's most frequent words and pieces of words, lists of a fixed length, counted over all its texts."""

    def __init__(self, docs: DataFrame | None):
        self.words, self.pieces = [], []
        if docs is None:
            return
        letters = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![a-z0-9])[a-z]{4,12}(?![a-z0-9])"), F.lit(0))
        counts = written(docs.select(F.explode(letters).alias("w")).groupBy("w").count().where("count > 1"), "words")
        self.words = [r[0] for r in counts.orderBy(F.desc("count"), "w").limit(WORDS).collect()]
        cut = counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 3), lambda i: F.substr("w", i, F.lit(4)))).alias("p"), "count")
        self.pieces = [r[0] for r in cut.groupBy("p").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "p").limit(PIECES).collect()]

    def covered(self, value: Column) -> Column:
        """Share of a value's characters in frequent words or within frequent pieces of words."""
        runs = F.regexp_extract_all(F.lower(value), F.lit("[a-z]+"), F.lit(0))
        parts = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 3)), lambda i: F.substr(r, i, F.lit(4)))
        known = lambda r: F.when(r.isin(self.words), F.length(r)).otherwise(F.size(F.filter(parts(r), lambda p: p.isin(self.pieces))))
        total = F.aggregate(runs, F.lit(0), lambda acc, r: acc + known(r))
        return total / F.length(value) if self.words else F.lit(0.0)


def featured(rows: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Candidates with the columns of FEATURES."""
    v, n = F.col("value"), F.length("value").cast("double")
    kinds = F.translate(F.translate(F.translate(v, "bcdefghijklmnopqrstuvwxyz", "a" * 25), "BCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 25), "123456789", "0" * 9)
    count = lambda pattern: (n - F.length(F.regexp_replace(v, pattern, ""))) / n
    pairs = lambda *two: sum((F.regexp_count(kinds, F.lit(f"(?={x})")) for x in two), F.lit(0)) / n
    beside = F.concat_ws(" ", "before2", "before", F.regexp_extract("word", r"(?s)^.*?(?=[^=:]*$)", 0))
    return rows.withColumns(
        {
            "length": n,
            "transitions": F.regexp_count(kinds, F.lit(r"(?=(.)(?!\1).)")) / n,
            "lower_digit": pairs("a0", "0a"),
            "lower_upper": pairs("aA", "Aa"),
            "digit_share": count("[0-9]"),
            "upper_share": count("[A-Z]"),
            "hex_share": count("[0-9a-f]"),
            "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
            "dictionary": dictionary.covered(v).cast("double"),
            "longest_letters": F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), F.length)).cast("double"),
            "dashes": count("[-_]"),
            "dots": count("[.]"),
            "slashes": count("/"),
            # Characters in parts that signs set off and that are letters of one case: names are made of such.
            "word_share": (n - F.length(F.regexp_replace(v, r"(?<![A-Za-z0-9])([A-Z]?[a-z]{2,}|[A-Z]{2,})(?![A-Za-z0-9])", ""))) / n,
            "path": F.col("word").rlike(r"://|^[\"'(]?[/.]|(?<![A-Za-z0-9])[a-z][a-z0-9._-]*/[a-z0-9._-]+/|\.(py|js|txt|html|json|md|com|org|net)\b").cast("double"),
            "mail": F.col("word").contains("@").cast("double"),
            "named": _named(beside, NAMES).cast("double"),
            "against": _named(beside, AGAINST).cast("double"),
            "quoted": F.col("word").rlike("[\"'`]").cast("double"),
            "assigned": (F.col("before").rlike("[=:]$") | F.col("word").rlike("[=:].")).cast("double"),
        }
    )


def labelled_findings(rows: DataFrame) -> DataFrame:
    """The candidates whose form or place leaves no doubt, with label: 1.0 a credential, 0.0 none. It looks at texts, not at features."""
    v, word = F.col("value"), F.col("word")
    issued = F.lit(False)
    for form in ISSUED:
        issued = issued | v.rlike(form)
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    given = F.lower(F.col("before2")).rlike(r"(^|[^a-z])(" + "|".join(NAMES) + r")[\"']?$") & F.col("before").isin("=", ":", ":=")
    inside = F.lower(word).rlike(r"(^|[^a-z])(" + "|".join(NAMES) + r")[\"']?[=:]")
    place = word.contains("@") | word.rlike("://") | v.rlike(r"^\.{0,2}/|^[a-z0-9._-]+(/[a-z0-9._-]+){2,}$")
    # Names that programs give to things, and what stands in a page or a lock file for its content.
    wordy = v.rlike(r"^([a-z]{2,}|v?[0-9]{1,4})([_.-]+([a-z]{2,}|v?[0-9]{1,4}))+$") & v.rlike("[a-z]{3}")
    embedded = v.rlike("^sha(256|384|512)-") | word.rlike(r"(?i)base64,|sha(256|384|512)-")
    digest = v.rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$") & F.lower(F.concat_ws(" ", "before2", "before")).rlike(r"\b(" + "|".join(AGAINST) + r")\b")
    plain = v.rlike("^[A-Za-z]+([._-][A-Za-z]*)*$")
    label = F.when(issued & ~embedded, 1.0).when(place | digest | wordy | embedded, 0.0).when((given | inside) & mixed, 1.0).when(plain & ~given & ~inside, 0.0)
    return rows.withColumn("label", label).where("label is not null")


def example_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """doc_id, text: lines with credentials of published formats and with look-alikes, their values cut from hashes."""
    hexes = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    mixed = lambda salt, size: F.substr(F.regexp_replace(F.base64(F.unhex(F.concat(hexes(salt), hexes(salt + "+")))), "[+/=]", "x"), F.lit(1), F.lit(size))
    wide = lambda salt, size: F.substr(F.regexp_replace(F.base64(F.unhex(F.concat(hexes(salt), hexes(salt + "-")))), "[=]", "y"), F.lit(1), F.lit(size))
    upper = lambda salt, size: F.upper(mixed(salt, size))
    lower = lambda salt: F.translate(F.lower(mixed(salt, 9)), "0123456789", "aeioulnrst")
    name = F.element_at(F.array(*[F.lit(x) for x in ("API_KEY", "db.password", "client_secret", "auth-token", "SECRET_KEY")]), (F.col("id") % 5 + 1).cast("int"))
    lines = [
        F.concat(F.lit("aws AKIA"), upper("a", 16), F.lit(" set")), F.concat(F.lit("GITHUB_TOKEN=ghp_"), mixed("b", 36)), F.concat(F.lit("use ghp_"), mixed("c", 36), F.lit(" here")),
        F.concat(F.lit("Authorization: Bearer eyJ"), mixed("d", 17), F.lit(".eyJ"), mixed("e", 30), F.lit("."), mixed("f", 43)), F.concat(F.lit("then eyJ"), mixed("g", 20), F.lit(".eyJ"), mixed("h", 40), F.lit("."), mixed("i", 43)),
        F.concat(name, F.lit(' = "'), mixed("j", 32), F.lit('"')), F.concat(name, F.lit("="), mixed("k", 24)), F.concat(name, F.lit(": '"), hexes("l"), F.lit("'")), F.concat(F.lit('{"'), name, F.lit('": "'), mixed("m", 12), F.lit('"}')),
        F.concat(F.lit('aws_secret_access_key = "'), wide("A", 20), F.lit("/"), mixed("B", 8), F.lit("/"), wide("C", 10), F.lit('"')), F.concat(F.lit("SECRET_KEY="), mixed("D", 9), F.lit("/"), mixed("E", 11), F.lit("+"), mixed("F", 18)), F.concat(F.lit("the password: '"), mixed("G", 10), F.lit("!' works")), F.concat(F.lit("access "), mixed("H", 14), F.lit("/"), mixed("I", 12), F.lit("/"), mixed("J", 12), F.lit(" granted")),
        F.concat(F.lit('cache_key = "'), lower("K"), F.lit("_"), lower("L"), F.lit("_page_v2_2024\"")), F.concat(F.lit("primary_key: "), lower("M"), F.lit("_"), lower("N"), F.lit("_id")), F.concat(F.lit('token_type="'), lower("O"), F.lit("-"), lower("P"), F.lit('"')), F.concat(F.lit('"integrity": "sha512-'), wide("Q", 43), F.lit("/"), wide("R", 42), F.lit('=="')), F.concat(F.lit("src=data:image/png;base64,iVBORw0KGgo"), wide("S", 40), F.lit("/"), wide("T", 43)), F.concat(F.lit('"key": "'), lower("U"), F.lit("."), lower("V"), F.lit('.title"')),
        F.concat(F.lit("slack xoxb-"), mixed("n", 12), F.lit("-"), mixed("o", 24)), F.concat(F.lit("pay sk_live_"), mixed("p", 24)),
        F.concat(F.lit("see commit "), F.substr(hexes("q"), F.lit(1), F.lit(40)), F.lit(" for more")), F.concat(F.lit("sha256 "), hexes("r"), F.lit(" file")), F.concat(F.lit("md5: "), F.md5(F.col("id").cast("string").cast("binary")), F.lit(" ok")),
        F.concat(F.lit("open /usr/"), lower("s"), F.lit("/lib/"), lower("t"), F.lit(".py now")), F.concat(F.lit("at src/"), lower("u"), F.lit("/"), lower("v"), F.lit("/main.js line")), F.concat(F.lit("go https://www."), lower("w"), F.lit(".com/docs/"), lower("x"), F.lit("/index.html")),
        F.concat(F.lit("write to "), lower("y"), F.lit("@"), lower("z"), F.lit(".example.org today")), F.concat(F.lit("the "), lower("1"), F.lit("-"), lower("2"), F.lit("-"), lower("3"), F.lit(" of")), F.concat(F.lit("uuid "), F.substr(hexes("4"), F.lit(1), F.lit(8)), F.lit("-"), F.substr(hexes("5"), F.lit(1), F.lit(4)), F.lit("-4"), F.substr(hexes("6"), F.lit(1), F.lit(3)), F.lit("-a"), F.substr(hexes("7"), F.lit(1), F.lit(3)), F.lit("-"), F.substr(hexes("8"), F.lit(1), F.lit(12))),
    ]
    return spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.element_at(F.array(*lines), (F.col("id") % len(lines) + 1).cast("int")).alias("text"))


def fit(findings: DataFrame):
    """A forest from labelled, featured findings, at most TRAIN_ROWS of each label taken by hash; None where a label is absent."""
    order = F.xxhash64(F.lit(SEED), "doc_id", "at", "value")
    sample = findings.where("label = 1").orderBy(order).limit(TRAIN_ROWS).unionByName(findings.where("label = 0").orderBy(order).limit(TRAIN_ROWS))
    hidden = sample.where(F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "at", "value"), F.lit(HIDDEN)) == 0).where("against = 0").withColumns({c: F.lit(0.0) for c in CONTEXT})
    sample = written(sample.unionByName(hidden).select(*FEATURES, "label"), "findings")
    counts = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    weighted = sample.withColumn("weight", F.when(F.col("label") == 1, 0.5 / counts[1.0]).otherwise(0.5 / counts[0.0]) * sum(counts.values()))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(weighted))


def scan(rows: DataFrame, model) -> DataFrame:
    """Featured candidates with score and is_secret (score of 0.5 or more). Without a model nothing is told apart: score 0.5, all kept."""
    if model is None:
        return rows.withColumns({"score": F.lit(0.5), "is_secret": F.lit(True)})
    got = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return got.withColumn("score", F.round(vector_to_array("probability")[1], 6)).withColumn("is_secret", F.col("score") >= 0.5)


def redacted(text: Column, values: Column) -> Column:
    """The text with each of the secret values replaced by a mark."""
    return F.aggregate(values, text, lambda t, v: F.replace(t, v, F.lit("<SECRET>")))


def secret_scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Every candidate of ``docs`` (doc_id, text) with its features, score and is_secret.

    ``findings`` are reviewed candidates with a label, featured by the same dictionary; without them ``labelled_findings``
    makes some. Null and empty texts have no candidates; rows that repeat a doc_id are scanned each; a text of any length is
    read whole. Equal values get equal scores where the words beside them are alike; which of equally hashed findings train
    is told by doc_id and place. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    dictionary = Dictionary(docs)
    rows = written(candidates(docs), "candidates")
    seen = featured(rows, dictionary)
    if findings is None:
        made = candidates(example_findings(docs.sparkSession).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text"))
        findings = featured(labelled_findings(rows.unionByName(made)), dictionary)
    return scan(seen, fit(findings))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of ``documents`` with its score; see ``secret_scan``."""
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("at").cast("long").alias("word_at"), F.col("run").cast("long").alias("run_at"), F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
