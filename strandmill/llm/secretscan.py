"""Secret scan: candidate strings, and a random forest that removes false ones.

Candidates are long runs of key characters, runs of any length after a key word,
and, where a key word is given a value by a sign, the whole value with whatever
signs it holds. The forest reads each one's length, transitions between kinds of
characters, coverage by dictionary words, the document's path and the
neighbouring words. It is trained from labelled findings and compiled to CASE
expressions, so that scoring stays in SQL.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh

_RUN = r"[A-Za-z0-9+/_\-]"
_WORDS = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_ \-]?key|access[_ \-]?key|auth(?:orization)?|bearer|credentials?|private[_ \-]?key|client[_ \-]?secret"
#: A value that a key word is given: no blanks, quotes, brackets, separators or at signs; an ampersand only where no other parameter starts.
_VALUE = r"[^\s\"'`<>,;(){}\[\]&@]+(?:&(?!\w{1,32}=)[^\s\"'`<>,;(){}\[\]&@]*){0,8}(?<![.:!?])"
#: A sign of assignment close before, which is cheaper to look for than a key word.
_GIVEN = r"(?<=[=:>]\s{0,3}[\"'(]?)"
_END = r"(?:={1,2}(?![A-Za-z0-9+/_\-=]))?"
#: Every given value, every whole run of 12 characters or more, and of any length after a key word.
CANDIDATE = (
    rf"{_GIVEN}(?<=(?i:{_WORDS})[\"']?\s{{0,3}}(?:=>|=|:)\s{{0,3}}[\"'(]?)(?=[^\s=>]){_VALUE}"
    rf"|(?<!{_RUN})(?:{_RUN}{{12,}}+|(?<=(?i:{_WORDS})[\"']?\s{{0,3}}(?:=>|=|:|is)?\s{{0,3}}[\"'(]?){_RUN}{{1,11}}+){_END}"
)
#: The same candidates in a text that holds no key word, where nothing needs to be looked for before them.
PLAIN_CANDIDATE = rf"(?<!{_RUN}){_RUN}{{12,}}+{_END}"
#: Characters of context on either side.
CONTEXT = 48
TREES = 24
DEPTH = 6
#: Labelled findings that train() reads at most.
FINDINGS = 20_000

_DICTIONARY = (
    "about above account action active address admin after again album alpha apple array article asset author backup banner before beta between block board "
    "border bottom bucket button cache camera center change channel charge check child class click client close cloud color column comment common config connect "
    "content control cookie count country create current custom daily dash data date debug default delete demo design detail device digest display document domain "
    "download draft edit email enable engine entry error event example export factor false feature feed field file filter final first folder form frame from "
    "gallery game general global grid group handle header height hello help hidden history home hotel house icon image import index info input insert install inter "
    "item job label language large last layer layout left level library light limit line link list load local location login logo long lorem main manager map march "
    "market master media member memory menu message meta method middle minor mobile model module monday month more movie music name native network news next node "
    "note number object offer office online open option order other output overview owner package page panel param parent part pass path pattern payment people "
    "photo phone place plan player plugin point policy popup portal position post power preview price print private process product profile project property public "
    "query question quick random range rate read record region release remove report request reset resource response result return review right role room route "
    "rule sale sample save scale schedule school score screen script search section select send series server service session setting shadow shape share sheet shop "
    "short show side sign simple single site size slide small social source space special spring stage standard start state static status step stock stop store story "
    "stream street string style submit summer support system table target team template test text theme this thumb ticket time title toggle token tool total track "
    "travel tree type under unit update upload user value version video view visit wall water week welcome width window winter with word work world write year zone "
    "changeme dummy fake foobar placeholder qwerty secret password your insert here none null todo"
).split()
_COVERED = "(?:" + "|".join(sorted(set(_DICTIONARY), key=lambda w: (-len(w), w))) + ")"
_PATH = r"(?i)(?:^|[/_.\-])(?:tests?|specs?|examples?|samples?|fixtures?|mocks?|docs?|demo|vendor|node_modules|dist|lock)(?:$|[/_.\-])|\.(?:lock|min\.js|svg|md|rst)$"
_NEAR = rf"(?i)(?:{_WORDS})[\"']?\s{{0,3}}(?:=>|=|:|is)?\s{{0,3}}[\"'(]?$"
_ASSIGNED = rf"(?i)(?:{_WORDS})[\"']?\s{{0,3}}(?:=>|=|:)\s{{0,3}}[\"'(]?$"
_USERINFO = r"://[^\s/@]{0,40}:$"
_FAR = r"(?i)(?:sha-?(?:1|256|512)?|md5|commit|checksum|hash|digest|uuid|guid|revision|etag|integrity|version|build|sequence|invoice|order|tracking|serial|isbn|id)[\"']?\s{0,3}(?:=|:|#|is)?\s{0,3}[\"'(]?$"
_KNOWN = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}|^(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|^sk-[A-Za-z0-9]{20,}|^xox[abprs]-[A-Za-z0-9\-]{10,}|^AIza[A-Za-z0-9_\-]{30,}|^eyJ[A-Za-z0-9_\-]{16,}|^glpat-[A-Za-z0-9_\-]{16,}"

#: name, SQL over c (candidate), b (before), a (after), p (path)
_CLASSES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[0-9]', '0'), '[a-z]', 'a'), '[A-Z]', 'A'), '[^0aA]', '-')"
_HEX = "^[0-9a-fA-F]+$"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


FEATURES: tuple[tuple[str, str], ...] = (
    ("length", "length({c})"),
    ("transitions", f"(length(regexp_replace({_CLASSES}, {_q('(.)' + chr(92) + '1+')}, '$1')) - 1) / length({{c}})"),
    ("coverage", f"1 - length(regexp_replace(lower({{c}}), {_q(_COVERED)}, '')) / length({{c}})"),
    ("digits", "length(regexp_replace({c}, '[^0-9]', '')) / length({c})"),
    ("capitals", "length(regexp_replace({c}, '[^A-Z]', '')) / length({c})"),
    ("variety", "size(array_distinct(split({c}, ''))) / least(length({c}), 24)"),
    ("separators", f"length(regexp_replace({{c}}, {_q('[A-Za-z0-9=]')}, '')) / length({{c}})"),
    ("hexadecimal", f"if(regexp_like({{c}}, {_q(_HEX)}), 1, 0)"),
    ("uuid", f"if(regexp_like({{c}}, {_q('^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-')}), 1, 0)"),
    ("known", f"if(regexp_like({{c}}, {_q(_KNOWN)}), 1, 0)"),
    ("runs", f"length({{c}}) - length(regexp_replace({{c}}, {_q('(.)' + chr(92) + '1{2,}')}, '$1'))"),
    ("path", f"if(regexp_like({{p}}, {_q(_PATH)}), 1, 0)"),
    ("near", f"if(regexp_like({{b}}, {_q(_NEAR)}), 1, 0)"),
    ("assigned", f"if(regexp_like({{b}}, {_q(_ASSIGNED)}), 1, 0)"),
    ("userinfo", f"if(regexp_like({{b}}, {_q(_USERINFO)}) and startswith({{a}}, '@'), 1, 0)"),
    ("named", "if(startswith({a}, '=') or startswith({a}, '@'), 1, 0)"),
    ("far", f"if(regexp_like({{b}}, {_q(_FAR)}), 1, 0)"),
    ("address", f"if(regexp_like({{b}}, {_q('(?:://|www' + chr(92) + '.|[/@.])[^ ]*$')}) or startswith({{a}}, '.'), 1, 0)"),
)


def feature_sql(c: str, b: str, a: str, p: str) -> str:
    """named_struct of all features as doubles."""
    def put(e: str) -> str:
        return e.replace("{c}", c).replace("{b}", b).replace("{a}", a).replace("{p}", p)

    return "named_struct(" + ", ".join(f"'{n}', cast({put(e)} as double)" for n, e in FEATURES) + ")"


def sample_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """``candidate, before, after, path, label``: labelled findings in the forms that reviewers meet.

    Deterministic; used where no reviewed table is given.
    """
    mixed = "translate(base64(unhex(concat(md5(concat('c', id)), md5(concat('d', id))))), '+/=', 'xYz')"
    parts = {
        "hexes": "md5(concat('a', id))",
        "more": "md5(concat('b', id))",
        "mixed": mixed,
        "word": "element_at(array('user', 'account', 'product', 'session', 'gallery', 'summer', 'release', 'template', 'station', 'chapter'), cast(id div {N} % 10 + 1 as int))",
        "year": "cast(1990 + id div {N} % 40 as string)",
        "digits": "translate(md5(concat('e', id)), 'abcdef', '012345')",
        "lead": "element_at(array('and then the ', 'as in ', 'we met ', 'see below. ', '', 'notes on '), cast(id div {N} % 6 + 1 as int))",
        "key": "element_at(array('password=', 'token = \"', 'api_key: ', 'secret=', 'passwd = ', 'access_key = \"', 'auth token: ', 'client_secret=\\'', 'pwd=', 'credential '), cast(id div {N} % 10 + 1 as int))",
        "letters": f"translate({mixed}, '0123456789', 'qWeRtYuIoP')",
        "prose": "element_at(array('international', 'responsibilities', 'characteristics', 'Notwithstanding', 'extraordinarily', 'well-established', 'Massachusetts', 'and/or-whatever', 'communication', 'Administration'), cast(id div {N} % 10 + 1 as int))",
        "brief": "element_at(array('was', 'ingredient', 'ceremony', 'protected', 'of', 'the', 'and', 'is', 'garden', 'Bearer'), cast(id div {N} % 10 + 1 as int))",
        "empty": "element_at(array('changeme', 'null', 'none', 'your', 'test', 'example', 'password', 'dummy', 'here', 'true'), cast(id div {N} % 10 + 1 as int))",
        "sign": "element_at(array('password=', 'token = \"', 'api_key: ', 'secret=', 'passwd = ', 'client_secret=\\''), cast(id div {N} % 6 + 1 as int))",
        "said": "element_at(array('the secret ', 'password is ', 'a token ', 'credentials ', 'of the password ', 'authorization '), cast(id div {N} % 6 + 1 as int))",
        "told": "element_at(array('the secret: ', 'Password: ', 'one token: ', 'credentials: '), cast(id div {N} % 4 + 1 as int))",
        "odd": "element_at(array('&', '#', '$', '%', '!', '*', '.', '~'), cast(id div {N} % 8 + 1 as int))",
        "login": "element_at(array('postgres://user:', 'https://bob:', 'amqp://svc-1:'), cast(id div {N} % 3 + 1 as int))",
    }
    forms = [
        ("substring(hexes, 1, 18)", "concat(lead, key)", 1),
        ("concat(hexes, substring(more, 1, 8))", "concat(lead, key)", 1),
        ("substring(mixed, 1, cast(16 + id % 24 as int))", "concat(lead, key)", 1),
        ("concat('AKIA', substring(upper(translate(mixed, '018', 'QRS')), 1, 16))", "lead", 1),
        ("concat('AKIA', substring(upper(mixed), 1, 16))", "lead", 1),
        ("concat('ghp_', substring(mixed, 1, 36))", "lead", 1),
        ("concat('sk_live_', substring(mixed, 1, 24))", "concat(lead, 'key ')", 1),
        ("concat('AKIA', substring(upper(hexes), 1, 8), substring(upper(mixed), 1, 8))", "concat(lead, 'AWS ')", 1),
        ("substring(mixed, 1, 40)", "concat(lead, 'secret ')", 1),
        ("substring(hexes, 1, cast(16 + id % 16 as int))", "concat(lead, key)", 1),
        ("substring(hexes, 1, 12)", "concat(lead, 'commit ')", 0),
        ("concat(hexes, substring(more, 1, 8))", "concat(lead, 'commit ')", 0),
        ("hexes", "concat(lead, 'md5: ')", 0),
        ("concat(hexes, more)", "concat(lead, 'sha256:')", 0),
        ("concat(hexes, substring(more, 1, 8))", "lead", 0),
        ("hexes", "lead", 0),
        ("concat_ws('-', substring(hexes, 1, 8), substring(hexes, 9, 4), substring(hexes, 13, 4), substring(hexes, 17, 4), substring(more, 1, 12))", "concat(lead, 'id ')", 0),
        ("concat_ws('-', substring(hexes, 1, 8), substring(hexes, 9, 4), substring(hexes, 13, 4), substring(hexes, 17, 4), substring(more, 1, 12))", "lead", 0),
        ("concat(word, '_settings_', year)", "lead", 0),
        ("concat('changeme', word, year)", "concat(lead, key)", 0),
        ("concat('your-', word, '-token-here-', id % 10)", "concat(lead, key)", 0),
        ("concat(word, 'Manager', year, 'Factory')", "lead", 0),
        ("concat('xxxxxxxxxxxx', id % 100)", "concat(lead, key)", 0),
        ("substring(digits, 1, 16)", "lead", 0),
        ("substring(digits, 1, cast(12 + id % 8 as int))", "concat(lead, 'order ')", 0),
        ("concat('assets/', word, '/image-', year, '-large')", "concat(lead, 'https://')", 0),
        ("substring(mixed, 1, 44)", "concat(lead, 'https://cdn.example.com/v/')", 0),
        ("concat(year, '-08-14T10-22-', id % 60, '-', word)", "lead", 0),
        ("substring(letters, 1, cast(14 + id % 20 as int))", "concat(lead, sign)", 1),
        ("concat(initcap(substring(letters, 1, 7)), initcap(substring(letters, 8, 5)), initcap(substring(letters, 13, 7)), initcap(substring(letters, 20, 6)))", "concat(lead, sign)", 1),
        ("lower(substring(letters, 1, cast(12 + id % 16 as int)))", "concat(lead, sign)", 1),
        ("concat('AKIA', substring(upper(letters), 1, 16))", "lead", 1),
        ("substring(mixed, 1, cast(8 + id % 16 as int))", "concat(lead, login)", 1, "'@host'"),
        ("substring(letters, 1, cast(8 + id % 16 as int))", "concat(lead, login)", 1, "'@host'"),
        ("substring(mixed, 1, cast(6 + id % 6 as int))", "concat(lead, sign)", 1),
        ("substring(hexes, 1, cast(6 + id % 6 as int))", "concat(lead, sign)", 1),
        ("prose", "lead", 0),
        ("prose", "concat(lead, said)", 0),
        ("brief", "concat(lead, said)", 0),
        ("empty", "concat(lead, sign)", 0),
        ("concat(substring(lower(letters), 1, 9), year)", "lead", 0, "'@example.com'"),
        ("concat(word, '_client_secret')", "lead", 0, "'='"),
        ("concat(substring(lower(letters), 1, 8), '_access_key')", "lead", 0, "' = \"'"),
        ("lower(substring(letters, 1, cast(12 + id % 8 as int)))", "lead", 0),
        ("concat(substring(letters, 1, cast(5 + id % 4 as int)), odd, substring(mixed, 8, cast(5 + id % 6 as int)), '!')", "concat(lead, sign)", 1),
        ("concat(substring(mixed, 1, cast(6 + id % 4 as int)), odd, substring(lower(letters), 8, cast(5 + id % 6 as int)))", "concat(lead, sign)", 1),
        ("upper(substring(letters, 1, cast(12 + id % 8 as int)))", "lead", 0),
        ("initcap(substring(letters, 1, cast(12 + id % 8 as int)))", "lead", 0),
        ("upper(prose)", "lead", 0),
        ("brief", "concat(lead, told)", 0),
        ("prose", "concat(lead, told)", 0),
        ("lower(substring(letters, 1, cast(3 + id % 6 as int)))", "concat(lead, told)", 0),
        ("concat(word, '-', substring(lower(letters), 1, 6), '-', word)", "lead", 0),
    ]
    count = len(forms)
    cases = lambda i: " ".join(f"when {k} then {f[i]}" for k, f in enumerate(forms) if len(f) > i)
    path = "element_at(array('src/main', 'src7', 'config/app.yaml', 'tests/fixtures/a', 'notes', 'docs/readme.md'), cast(id div 7 % 6 + 1 as int))"
    # Parts first, forms of them next: one expression of both is too long to be compiled.
    rows = spark.range(n).select("id", *(F.expr(e.replace("{N}", str(count))).alias(name) for name, e in parts.items()))
    return checkpoint(rows).select(
        F.expr(f"case id % {count} {cases(0)} end").alias("candidate"), F.expr(f"case id % {count} {cases(1)} end").alias("before"),
        F.expr(f"case id % {count} {cases(3)} else if(id % 3 = 0, ' and more', '\" it') end").alias("after"), F.expr(path).alias("path"), F.expr(f"case id % {count} {cases(2)} end").alias("label"),
    )


def _compiled(node, names: list[str]) -> str:
    """A tree's node as a CASE expression; a leaf is its share of the label 1."""
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / sum(stats)!r}D"
    split = node.split()
    return f"case when {names[split.featureIndex()]} <= {split.threshold()!r}D then {_compiled(node.leftChild(), names)} else {_compiled(node.rightChild(), names)} end"


def featured(findings: DataFrame, limit: int = FINDINGS) -> DataFrame:
    """``label, features`` of the labelled findings that train() reads."""
    from pyspark.ml.feature import VectorAssembler

    # Read once; and expressions that make findings up would else be repeated in every feature.
    found = checkpoint(findings.where("label is not null and candidate is not null and candidate <> ''").select("candidate", "before", "after", "path", "label"))
    known = found.select(
        F.col("label").cast("double").alias("label"), F.expr(feature_sql("candidate", "coalesce(before, '')", "coalesce(after, '')", "coalesce(path, '')")).alias("f"), F.xxhash64("candidate", "before").alias("__h")
    )
    rows = known.orderBy("__h", "label").limit(limit).select("label", "f.*")
    return checkpoint(VectorAssembler(inputCols=[n for n, _ in FEATURES], outputCol="features").transform(rows))


def grow(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
    """A random forest from ``label, features``."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows.select("label", "features").coalesce(1))


def forest_sql(forest, prefix: str = "f.") -> str:
    """A forest's probability of the label 1, as SQL over the features' names."""
    each = [_compiled(t._java_obj.rootNode(), [prefix + n for n, _ in FEATURES]) for t in forest.trees]
    return "(" + " + ".join(each) + f") / {len(each)}D"


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, limit: int = FINDINGS, seed: int = 11) -> str:
    """A random forest from labelled findings, as SQL over the features' names (``f.`` before each).

    The value is the mean of the trees' shares of secrets. Rows without a label or
    a candidate are ignored; nulls elsewhere count as empty. At most ``limit`` rows,
    those with the least hashes, are read. With one label only, it is the answer;
    without any, nothing is a secret.
    """
    rows = featured(findings, limit)
    labels = {r[0] for r in rows.select("label").distinct().limit(3).collect()}
    if len(labels) < 2:
        return f"{max(labels, default=0.0)}D"
    return forest_sql(grow(rows, trees, depth, seed))


#: Pieces whose places are summed up one by one; such blocks are summed up in turn.
_STEP = 256


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, worked out once. A column of that value would be
    put in wherever it is named, and be worked out anew for each element of an array."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scored(docs: DataFrame, forest: str, text: str, path: str | None, found: str) -> DataFrame:
    """Add a struct ``found``, null if there is no candidate: ``pieces``, the text cut into what lies between
    candidates and the candidates, in turn; and ``each``, an array of struct(candidate, start, before, after, score).

    All is done within the row, in time linear in the text: each candidate sees the
    pieces beside it, back to the one before the last candidate but one, and takes
    its place from running sums in blocks. Exploding an array of one keeps filters
    on what is added from being moved before it, where all would be done twice.
    """
    own = f"coalesce(cast(`{text}` as string), '')"
    where = f"coalesce(cast(`{path}` as string), '')" if path else "''"

    def pieces(pattern: str) -> str:
        rx = _q(pattern)
        return f"if(regexp_like({own}, {rx}), flatten(zip_with(split({own}, {rx}, -1), regexp_extract_all({own}, {rx}, 0), (g, c) -> if(c is null, array(g), array(g, c)))), null)"

    cut = f"if(regexp_like({own}, {_q(f'(?i){_WORDS}')}), {pieces(CANDIDATE)}, {pieces(PLAIN_CANDIDATE)})"
    block = f"slice(lens, j * {_STEP} + 1, {_STEP})"
    sums = f"transform(sequence(0, (size(lens) - 1) div {_STEP}), j -> aggregate({block}, 0L, (a, x) -> a + x))"
    heads = f"aggregate({sums}, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)), a -> slice(a, 1, size(a) - 1))"
    starts = f"flatten(transform({heads}, (h, j) -> aggregate({block}, array(h), (a, x) -> concat(a, array(element_at(a, -1) + x)), a -> slice(a, 1, size(a) - 1))))"
    before = ", ".join(f"right(get(pieces, i - {k}), {CONTEXT})" for k in (5, 4, 3, 2, 1))
    placed = f"""transform(sequence(1, size(pieces) - 2, 2), i -> named_struct(
        'c', pieces[i], 's', starts[i], 'b', right(concat_ws('', {before}), {CONTEXT}), 'a', left(pieces[i + 1], {CONTEXT})))"""
    feats = f"transform({placed}, x -> named_struct('x', x, 'f', {feature_sql('x.c', 'x.b', 'x.a', where)}))"
    scored = f"transform({feats}, y -> named_struct('candidate', y.x.c, 'start', y.x.s, 'before', y.x.b, 'after', y.x.a, 'score', {forest.replace('f.', 'y.f.')}))"
    lens = "transform(pieces, p -> cast(length(p) as bigint))"
    both = f"named_struct('pieces', pieces, 'each', {scored})"
    whole = _let("pieces", cut, f"if(pieces is null, null, {_let('lens', lens, _let('starts', starts, both))})")
    return docs.select("*", F.explode(F.array(F.expr(whole))).alias(found))


def scan(docs: DataFrame, forest: str, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """``key, start, end, candidate, score, secret``: one row per candidate; offsets are code points, ends exclusive.

    Null and empty texts have none; a null path is an empty one. Texts are read
    whole, however long; repeated rows give repeated results. Other columns,
    whatever their names, are ignored.
    """
    cols = [F.col(key).alias("__key"), F.col(text).alias("text"), *([F.col(path).alias("path")] if path else [])]
    found = _scored(docs.select(*cols), forest, "text", "path" if path else None, "__found")
    # Not a column alone, of which a filter before the explosion would be inferred.
    rows = found.select("__key", F.explode(F.slice("__found.each", 1, 1 << 30)).alias("x"))
    end = F.col("x.start") + F.char_length("x.candidate")
    return rows.select(F.col("__key").alias(key), F.col("x.start").alias("start"), end.cast("long").alias("end"), F.col("x.candidate").alias("candidate"), F.col("x.score").alias("score"), (F.col("x.score") >= 0.5).alias("secret"))


def redact(docs: DataFrame, forest: str, text: str = "text", path: str | None = "source", chars: str | None = "n_chars", by: str = "[secret]") -> DataFrame:
    """The documents with each secret's characters replaced in ``text``, and ``chars`` counted anew where something was.

    No document goes. Null and empty texts, and texts without secrets, stay as they
    are; all columns keep their names, types and, but for these two, values.
    """
    found, new = fresh(docs, "__found"), fresh(docs, "__new")
    put = f"array_join(transform(`{found}`.pieces, (p, i) -> if(i % 2 = 1 and `{found}`.each[cast(i div 2 as int)].score >= 0.5D, {_q(by)}, p)), '')"
    t = _scored(docs, forest, text, path, found).withColumn(new, F.expr(f"if(exists(`{found}`.each, y -> y.score >= 0.5D), {put}, null)"))
    out = {text: F.coalesce(F.col(new), F.col(text).cast("string"))}
    if chars and chars in docs.columns:
        out[chars] = F.when(F.col(new).isNotNull(), F.char_length(new)).otherwise(F.col(chars)).cast(docs.schema[chars].dataType)
    return t.withColumns(out).select(*(F.col(f"`{c}`") for c in docs.columns))
