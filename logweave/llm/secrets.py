"""Secret scans in DataFrame functions only: candidates by patterns, false positives removed by a random forest.

Candidates are strings that may be credentials: tokens of known shape, quoted or bare values after a name such as token or password,
private key blocks, credentials in a URL, and long runs of base64 or hex signs, all of any length. They are found in whole texts by one pattern
in one pass: matches are set between marks, and the text is cut there, so that a candidate's offset, the text before it and the
text after it are known without a second search. A text goes through the pattern only if it has one of the strings without which
there is no match (`possible`); these are looked up far faster than a pattern runs.

Features of a candidate: its length, shares of digits, upper-case letters and signs, distinct characters, character transitions (changes between
lower case, upper case, digits and signs; vowels next to consonants; repeats), dictionary coverage (share of
its characters in words of a list), the path (whether the source speaks of tests, examples, documents, or of
configuration), and the neighbouring words (names of secrets, of examples and of digests before it, examples after it, an assignment before it).

The forest (TREES trees of depth DEPTH, fixed seed) is trained in the JVM from labelled findings: a table of text before, candidate, text after, path
and label. To score, its trees are written out as SQL conditions on the features, so a text's candidates are judged in its own row: nothing is
joined or shuffled, and a text of many candidates costs only their number. `labelled_findings` makes one by rule where there is none of one's own: FINDINGS rows, from hash functions, of
credentials and of what is mistaken for them. Its size is fixed, and so is the forest's.

Cases: a null or empty text has no candidates. Null paths count as empty. Overlapping candidates do not occur; repeated rows give
repeated findings. Very long texts are scanned whole. Null ids pass. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH, FINDINGS = 30, 5, 4000
CONTEXT = 60
CHUNK = 256
MARK = "\ufdd0"  # a code point that is no character

# Shapes of credentials, in the order in which they are tried.
SHAPES = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?",
    r"\b(?:AKIA|ASIA|AGPA|AIDA)[A-Z0-9]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}",
    r"\bgithub_pat_[A-Za-z0-9_]{30,}",
    r"\bglpat-[A-Za-z0-9_-]{20,}",
    r"\bxox[abposr]-[A-Za-z0-9-]{10,}",
    r"\b(?:sk|pk|rk)[_-](?:live|test|ant|proj)?[_-]?[A-Za-z0-9_-]{16,}",
    r"\bAIza[A-Za-z0-9_-]{35}",
    r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+",
    r"(?<=://)[^\s/:@\"'<>]++:[^\s/@\"'<>]{3,}+(?=@)",
    r"(?<![A-Za-z0-9+/=_-])(?!(?<=:)//[^\s/:@\"'<>]++:[^\s/@\"'<>]{3,}+@)[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])",
)
# A value after a name (also a quoted one, as keys of JSON are, or a tag) or after the scheme of an authorisation: what stands before the value is matched too, and then taken off; a look behind
# would be tried at every character. A value in quotes goes up to the closing quote of its line.
NAMED = r"(?i:token|secret|password|passphrase|passwd|pwd|api[_-]?key|access[_-]key|auth_key|private[_-]key|credential|authorization|auth|bearer)"
SCHEME = r"(?i:bearer|basic|token)\s{1,3}"
ASSIGNED = rf"(?:{NAMED}(?:[\"'`]?\s{{0,3}}[=:]{{1,2}}>?\s{{0,3}}|>)[\"'`]?(?:{SCHEME})?|\b(?i:bearer|basic)\s{{1,3}}(?=[A-Za-z0-9._~+/-]{{16}}))"
VALUE = r"(?:(?<=\")[^\"\r\n]{6,}+(?=\")|(?<=')[^'\r\n]{6,}+(?=')|(?<=`)[^`\r\n]{6,}+(?=`)|[^\s\"'`,;<>(){}\[\]|]{6,}+)"
PATTERN = ASSIGNED + VALUE + "|" + "|".join(SHAPES)

# Words that candidates and their surroundings are held against.
DICTIONARY = tuple(
    "the and for you your this that with from have not are was will can one all new more about has use api key token secret password user name test example sample demo dummy fake placeholder change here insert value default config client server service account access auth data file path index list item page home main class function method string number public private static final void return import module version release build debug error message request response handler manager factory controller component container element button header footer image color style width height content text title html http https www com org net local host port base encode decode hash digest commit branch merge master develop production staging".split()
)
NAMES = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|passwd|pwd|api[_-]?key|access[_-]?key|credential|bearer|auth|private|basic\s)"
EXAMPLES = r"(?i)(?:example|sample|dummy|fake|placeholder|changeme|change_me|your[_ -]|xxxx|test|insert|replace|todo|redacted|<|\$\{|\{\{)"
DIGESTS = r"(?i)(?:sha-?\d*|md5|crc|checksum|digest|commit|revision|etag|integrity|uuid|guid|hash|fingerprint|version|build|trace|span|request)[\s_-]{0,3}(?:id)?\W{0,4}$"


# Strings of which every match of PATTERN has one, in lower case and as they are; other matches are logins in URLs, or have 32 signs in a row.
PARTS = ("private key", "glpat-", "xox", "sk-", "sk_", "pk-", "pk_", "rk-", "rk_", "token", "secret", "password", "passphrase", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "access-key", "private_key", "private-key", "auth", "credential", "bearer", "basic")
EXACT = ("AKIA", "ASIA", "AGPA", "AIDA", "eyJ")
LONG = r"[A-Za-z0-9+/_-]{32}"


def possible(text: Column) -> Column:
    """Whether a text can have a candidate; false only where PATTERN has no match."""
    either = lambda tests: reduce(lambda a, b: a | b, tests)
    named = F.exists(F.array(F.lower(text)), lambda lower: either([F.contains(lower, F.lit(x)) for x in PARTS]))  # lower case is made once
    return (F.contains(text, F.lit("://")) & F.contains(text, F.lit("@"))) | either([F.contains(text, F.lit(x)) for x in EXACT]) | named | text.rlike(LONG)


def cut(text: Column) -> Column:
    """Piece 0, match 0, piece 1, match 1, ..., last piece: together the text. Texts that hold the mark itself are searched twice instead."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    pieces, found = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    twice = F.slice(F.flatten(F.zip_with(pieces, found, lambda p, m: F.array(p, m))), F.lit(1), 2 * F.size(pieces) - 1)
    return F.when(~possible(text), F.array(text)).when(F.contains(text, F.lit(MARK)), twice).otherwise(marked)


def value(match: Column) -> Column:
    """The candidate in a match: without the name and the assignment before it."""
    return F.regexp_replace(match, "^" + ASSIGNED, "")


def spots(parts: Column) -> Column:
    """Offsets and surroundings of the candidates of a text that is cut as `cut` does, CHUNK of them at a time."""
    empty = F.array().cast("array<struct<start:int,before:string,candidate:string,after:string>>")
    number = F.floor(F.size(parts) / 2).cast("int")

    def step(acc: Column, k: Column) -> Column:
        before, whole, after = F.get(parts, 2 * k), F.get(parts, 2 * k + 1), F.get(parts, 2 * k + 2)
        here = value(whole)
        name = F.left(whole, F.length(whole) - F.length(here))
        at = acc["at"] + F.length(before)
        one = F.struct((at + F.length(name)).cast("int").alias("start"), F.right(F.concat(F.right(before, F.lit(CONTEXT)), name), F.lit(CONTEXT)).alias("before"), here.alias("candidate"), F.left(after, F.lit(CONTEXT)).alias("after"))
        return F.struct((at + F.length(whole)).cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunk(acc: Column, first: Column) -> Column:
        inner = F.aggregate(F.sequence(first, F.least(first + CHUNK, number) - 1), F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], i["out"]).alias("out")))[0]

    firsts = F.when(number > 0, F.sequence(F.lit(0), number - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, F.struct(F.lit(0).alias("at"), empty.alias("out")), chunk)["out"]


FEATURES = ("size", "digits", "uppers", "signs", "distinct", "turns", "vowels", "repeats", "covered", "path_test", "path_config", "name_before", "example_near", "digest_before", "assigned", "shape", "spaces", "quoted")


WORDS = "(?i)(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")"


def features(path: Column, before: Column, c: Column, after: Column) -> list[Column]:
    """A double column for each of FEATURES."""
    size = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    flag = lambda condition: condition.cast("double")
    made = {
        "size": size,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "signs": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "turns": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])"),
        "vowels": share("(?i)[aeiou](?=[bcdfghj-np-tv-z])|[bcdfghj-np-tv-z](?=[aeiou])"),
        "repeats": share(r"(.)(?=\1)"),
        "covered": (size - F.length(F.regexp_replace(c, WORDS, ""))) / size,
        "path_test": flag(path.rlike("(?i)test|spec|example|sample|fixture|mock|doc|readme|tutorial")),
        "path_config": flag(path.rlike(r"(?i)config|settings|\.env|\.ya?ml|\.ini|\.properties|secret|deploy|prod")),
        "name_before": flag(F.right(before, F.lit(30)).rlike(NAMES)),
        "example_near": flag(F.concat(before, F.lit(" "), c, F.lit(" "), F.left(after, F.lit(20))).rlike(EXAMPLES)),
        "digest_before": flag(F.right(before, F.lit(30)).rlike(DIGESTS)),
        "assigned": flag(F.right(before, F.lit(16)).rlike(rf"(?:[=:>]\s*[\"'`]?(?:{SCHEME})?|(?i:bearer|basic)\s+)$")),
        "shape": flag(c.rlike("^(?:" + "|".join(SHAPES[:9]) + ")")),
        "spaces": share(r"\s"),
        "quoted": flag(F.right(before, F.lit(1)).isin('"', "'", "`")),
    }
    return [F.coalesce(made[k], F.lit(0.0)).alias(k) for k in FEATURES]


def labelled_findings(spark: SparkSession, number: int = FINDINGS, first: int = 0) -> DataFrame:
    """`number` labelled findings by rule: (path, before, candidate, after, label); half of them are credentials, also behind the scheme of an authorisation, behind keys of JSON, and as phrases in quotes. `first`: where to begin;
    findings of other beginnings are others."""
    i = F.col("id")
    pick = lambda k, *choices: F.get(F.array(*[F.lit(x) for x in choices]), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(choices))).cast("int"))
    hexed = lambda k: F.sha2(F.concat(i.cast("string"), F.lit(f"/{k}")), 256)
    cut = lambda c, k, low, high: F.left(c, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(high - low + 1)).cast("int") + low)
    base = lambda k: F.regexp_replace(F.base64(F.unhex(F.concat(hexed(k), hexed(k + 1)))), "[+/=\\s]", "")
    word = lambda k: pick(k, *DICTIONARY)
    kind = F.pmod(i, F.lit(18))
    secret = (kind < 8) | (kind == 16)
    prose = pick(1, "set ", "the line ", "with ", "for this ", "or else ", "and then ", "value ", "export ", "")
    named = F.concat(prose, pick(2, "token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "pwd", "bearer", "passphrase"), pick(3, " = ", "=", ": ", ":", '": ', '":'), pick(4, '"', "'", ""))
    header = F.concat(prose, pick(66, "Authorization: Bearer ", "authorization: Basic ", "Authorization: token ", '"Authorization": "Bearer ', "-H 'Authorization: Bearer ", "Bearer "))
    gap = pick(67, " ", " ", ", ", ";", "-")
    called = lambda k: F.concat(pick(k, "copper", "violet", "harbor", "maple", "thunder", "pencil", "marble", "walnut", "orbit", "saddle", "Canyon", "Lantern"), F.when(F.pmod(F.xxhash64(i, F.lit(k + 1)), F.lit(2)) == 0, F.pmod(F.xxhash64(i, F.lit(k + 2)), F.lit(100)).cast("string")).otherwise(F.lit("")))
    plain = F.concat(prose, pick(5, "see ", "in ", "commit ", "sha256: ", "md5 = ", "checksum: ", "id: ", "file ", "build-", "etag: ", "revision ", "/static/js/"))
    candidate = (
        F.when(kind == 0, cut(hexed(10), 11, 32, 64))
        .when(kind == 1, cut(base(12), 13, 20, 64))
        .when(kind == 2, F.concat(F.lit("AKIA"), F.upper(F.left(base(14), F.lit(16)))))
        .when(kind == 3, F.concat(F.lit("ghp_"), F.left(base(16), F.lit(36))))
        .when(kind == 4, F.concat(cut(base(18), 19, 8, 14), pick(20, "!", "#", "$", "%", "")))
        .when(kind == 5, F.concat(F.lit("eyJ"), cut(base(21), 22, 12, 30), F.lit("."), cut(base(23), 24, 20, 60), F.lit("."), cut(base(25), 26, 20, 43)))
        .when(kind == 6, F.left(hexed(28), F.lit(40)))
        .when(kind == 7, F.concat(pick(29, "sk_live_", "sk-", "xoxb-", "glpat-"), cut(base(30), 31, 24, 48)))
        .when(kind == 8, cut(hexed(32), 33, 32, 64))
        .when(kind == 9, F.concat_ws("_", word(34), word(35), word(36), word(37)))
        .when(kind == 10, F.concat(F.initcap(word(38)), F.initcap(word(39)), F.initcap(word(40)), F.initcap(word(41)), F.initcap(word(42)), F.initcap(word(43)), F.initcap(word(44))))
        .when(kind == 11, pick(45, "your_api_key_here", "changeme", "xxxxxxxxxxxxxxxxxxxxxxxx", "<insert-token-here>", "REPLACE_WITH_YOUR_TOKEN", "example_password", "00000000000000000000", "${SECRET_TOKEN}", "dummy-secret-value", "placeholder"))
        .when(kind == 12, F.regexp_replace(F.left(hexed(46), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
        .when(kind == 13, F.concat_ws("/", word(47), word(48), word(49), word(50), word(51), word(52), word(53)))
        .when(kind == 14, F.concat_ws("-", word(54), word(55), word(56), word(57), word(58), word(59)))
        .when(kind == 16, F.concat(called(70), gap, called(73), gap, called(76), pick(79, "!", "7", "#4", "X9", "22")))
        .when(kind == 17, F.concat_ws(" ", pick(80, "the", "this", "your", "a"), word(81), pick(82, "is", "of", "and", "for"), word(83), word(84), pick(85, "here", "", "below", "page")))
        .otherwise(F.repeat(pick(60, "-", "=", "_", "a", "ab", "abc", "x0"), 20))
    )
    headed = kind.isin(0, 1, 5, 7) & (F.pmod(F.xxhash64(i, F.lit(68)), F.lit(4)) == 0)
    quoted = F.concat(F.regexp_replace(named, "[\"']$", ""), F.lit('"'))
    before = F.when(kind.isin(16, 17), quoted).when(headed, header).when((kind < 8) & ~kind.isin(2, 3), named).when(kind.isin(2, 3), pick(61, "key ", "use ", "token=", "", "= ")).when(kind.isin(11), named).when(kind.isin(9, 10, 14), F.when(F.pmod(F.xxhash64(i, F.lit(62)), F.lit(3)) == 0, named).otherwise(plain)).otherwise(plain)
    path = F.when(secret, pick(63, "config/app.yml", "src/main.py", ".env", "page.html", "deploy/prod.ini", "", "lib/util.go")).otherwise(pick(64, "tests/test_app.py", "docs/readme.md", "src/main.py", "page.html", "package-lock.json", "", "lib/util.go", "examples/demo.js"))
    after = pick(65, '" and more text', "\n", "' // keep", " in the log", ",", '"', "")
    return spark.range(first, first + number).select(path.alias("path"), before.alias("before"), candidate.alias("candidate"), after.alias("after"), secret.cast("double").alias("label"))


class Forest:
    """A trained forest as an SQL expression over a struct of the features."""

    def __init__(self, model: RandomForestClassificationModel):
        self.trees = [self._read(t._java_obj.rootNode()) for t in model.trees]

    def _read(self, node) -> tuple | float:
        if node.subtreeDepth() == 0:
            stats = [float(x) for x in node.impurityStats().stats()]
            return stats[1] / max(1e-300, sum(stats))
        split = node.split()
        return split.featureIndex(), float(split.threshold()), self._read(node.leftChild()), self._read(node.rightChild())

    def sql(self, name: str) -> str:
        """The mean over the trees of the share of secrets in the leaf, for a struct called `name`."""

        def of(node) -> str:
            return repr(node) + "D" if isinstance(node, float) else f"if({name}.{FEATURES[node[0]]} <= {node[1]!r}D, {of(node[2])}, {of(node[3])})"

        return "(" + " + ".join(map(of, self.trees)) + f") / {len(self.trees)}"

    def chance(self, values: dict[str, float]) -> float:
        """The same for plain numbers."""

        def of(node) -> float:
            return node if isinstance(node, float) else of(node[2] if values[FEATURES[node[0]]] <= node[1] else node[3])

        return sum(map(of, self.trees)) / len(self.trees)


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    """Train the forest on labelled findings (path, before, candidate, after, label 0 or 1)."""
    rows = findings.select("label", *features(F.coalesce("path", F.lit("")), F.coalesce("before", F.lit("")), F.col("candidate"), F.coalesce("after", F.lit(""))))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return Forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors))


def judged(docs: DataFrame, forest: Forest, text_col: str, path_col: str, *keep: Column) -> DataFrame:
    """keep, the text's parts _cut (see `cut`) and _found: array of start, length, candidate and chance."""
    text, path = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit(""))
    rows = docs.select(*keep, path.alias("_path"), cut(text).alias("_cut"))
    rows = rows.withColumn("_s", spots(F.col("_cut")))
    rows = rows.withColumn("_f", F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["candidate"].alias("candidate"), *features(F.col("_path"), s["before"], s["candidate"], s["after"]))))
    return rows.withColumn("_found", F.expr(f"transform(_f, f -> named_struct('start', f.start, 'length', length(f.candidate), 'candidate', f.candidate, 'chance', {forest.sql('f')}))")).drop("_path", "_s", "_f")


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, candidate, chance, secret): every candidate, its offset in code points, and whether the forest takes it for a secret."""
    maybe = docs.where(possible(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    rows = judged(maybe, forest, text_col, path_col, F.col(f"`{id_col}`").alias("doc_id")).select("doc_id", F.explode("_found").alias("f"))
    return rows.select("doc_id", "f.start", "f.length", "f.candidate", "f.chance", (F.col("f.chance") >= threshold).alias("secret"))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source", threshold: float = 0.5, mark: str = "[SECRET]", size_col: str | None = None) -> DataFrame:
    """docs with every secret in the text replaced by `mark`; all rows and columns stay, and each row is read once. size_col: a column
    that is set to the text's length where it changes."""
    own = docs.columns
    rows = judged(docs, forest, text_col, path_col, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("_row"))

    def part(p: Column, i: Column) -> Column:
        """A part as it stays: pieces, at even places, as they are."""
        one = F.get(F.col("_found"), F.floor(i / 2).cast("int"))
        return F.when((i % 2 == 1) & (one["chance"] >= threshold), F.concat(F.left(p, F.length(p) - one["length"]), F.lit(mark))).otherwise(p)

    rows = rows.withColumn("_any", F.exists("_found", lambda f: f["chance"] >= threshold))
    rows = rows.withColumn("_text", F.when(F.col("_any"), F.array_join(F.transform("_cut", part), "")))

    def column(i: int, c: str) -> Column:
        old = F.col(f"_row.c{i}")
        if c == text_col:
            return F.coalesce("_text", old).alias(c)
        if c == size_col:
            return F.when(F.col("_any"), F.length("_text").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return rows.select(*[column(i, c) for i, c in enumerate(own)])
