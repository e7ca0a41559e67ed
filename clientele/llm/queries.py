"""The numbered queries over whole tables, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm import bpe, chat, fingerprint, jaccard, language_id, mixing, packing, secrets, suffixes, topk, trie, urls, whitening
from clientele.llm.common import hex_digest, table
from clientele.operators.ordering import settled

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return register


# CRC-32 bit by bit: each byte is followed by eight shifts, written as -1
_HELD_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: [CAST(unicode(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, v:
    CASE WHEN v >= 0 THEN xor(a, v) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 5 = 0"""
OP1_SQL = rf"""
WITH docs AS (SELECT doc_id, lang, coalesce({_HELD_SQL}, true) AS held_out,
                     trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) AS t FROM documents),
points AS (SELECT doc_id, list_transform(string_split(' ' || t || ' ', ''), lambda c: CASE WHEN c = ' ' THEN 1::BIGINT ELSE unicode(c) END) AS p
           FROM docs WHERE t <> ''),
codes AS (SELECT doc_id, unnest(list_concat(list_filter(p, lambda x: x <> 1),
            list_transform(range(1, len(p)), lambda i: (p[i] << 21) | p[i + 1]),
            list_transform(range(1, len(p) - 1), lambda i: (((p[i] << 21) | p[i + 1]) << 21) | p[i + 2]))) AS gram FROM points),
counts AS (SELECT doc_id, gram, count(*) AS n FROM codes GROUP BY ALL),
profiles AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS place
             FROM counts JOIN docs USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY place < 400),
own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS place FROM counts QUALIFY place < 400),
away AS (SELECT o.doc_id, l.lang, count(*) AS grams, sum(CASE WHEN p.place IS NULL THEN 400 ELSE abs(p.place - o.place) END) AS d
         FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.gram = o.gram GROUP BY ALL),
best AS (SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - CAST(d AS DOUBLE) / (400 * grams), 0.0::DOUBLE) AS score
FROM docs LEFT JOIN best b USING (doc_id)
"""


@query("op1_language_id", OP1_SQL)
def op1(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    predicted = language_id.language_id(documents.select("doc_id", "text", "lang"))
    return predicted.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


OP2_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM docs),
classes AS (SELECT min(doc_id) AS v, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s),
entries AS (SELECT v, n, unnest(s) AS x FROM classes),
pairs AS (SELECT a.v AS a, b.v AS b, a.n AS n, b.n AS m, count(*) AS o FROM entries a JOIN entries b ON a.x = b.x AND a.v < b.v GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * o >= 80 * (n + m - o)),
ends AS (SELECT a AS v, b AS w FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT v, v AS r FROM classes UNION SELECT e.w, r.r FROM reach r JOIN ends e USING (v)),
roots AS (SELECT v, min(r) AS root FROM reach GROUP BY v)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN roots USING (v)
"""


@query("op2_jaccard_join", OP2_SQL)
def op2(spark: SparkSession, root: str) -> DataFrame:
    members, _ = jaccard.jaccard_join(table(spark, root, "documents"))
    return members.select("doc_id", "n_shingles", "component_id")


@query("op3_bpe")
def op3(spark: SparkSession, root: str) -> DataFrame:
    decoded = bpe.encode_decode(table(spark, root, "documents").select("doc_id", "text"))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          hex_digest(F.col("ids")).alias("ids_sha256"), hex_digest(F.col("decoded")).alias("decoded_sha256"))


@query("op4_fingerprints")
def op4(spark: SparkSession, root: str) -> DataFrame:
    made = fingerprint.fingerprints(table(spark, root, "documents"))
    return made.select("doc_id", "n_chars", hex_digest(F.col("edited")).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next")


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
                   row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
leveled AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
                   (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0.0::DOUBLE))
                   / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0::DOUBLE)) AS level
            FROM sources
            WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_open AS (SELECT level AS lv FROM leveled WHERE cap / w > level ORDER BY cap / w, place LIMIT 1),
shares AS (SELECT source, source_size, CASE WHEN cap / w > level THEN lv * w ELSE cap END AS target
           FROM leveled LEFT JOIN first_open ON true),
queued AS (SELECT d.*, source_size, target,
                  CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 13) AS BIGINT) AS shuffled
           FROM docs d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
sent AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY shuffled, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM queued),
passes AS (SELECT *, turn, (turn * source_size + upto) / target AS finish
           FROM sent, (VALUES (0), (1), (2)) t(turn) WHERE size > 0 AND turn < ceil(target / source_size)),
merged AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, shuffled, doc_id, size, turn ROWS UNBOUNDED PRECEDING) - size AS total FROM passes),
times AS (SELECT doc_id, count(*) AS times FROM merged WHERE total + size / 2 < (SELECT sum(target) FROM shares) GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken
FROM sent LEFT JOIN times USING (doc_id)
"""


@query("op5_source_mixing", OP5_SQL)
def op5(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _spans_sql(kind: str, pattern: str) -> str:
    gaps = "list_sum(list_transform(g[1:i], lambda x: length(x)))"
    met = "coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'kind': '{kind}', 'm': m[i],
        'start_': CAST({gaps} + {met} AS BIGINT)}})) AS s
    FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m FROM docs)"""


_NAMES = "|".join("".join(f"[{c}{c.upper()}]" for c in n) for n in ("password", "passwd", "secret", "token"))
_ASSIGN = (rf"({_NAMES}|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")
_MORE_SQL = {r.kind: r.pattern.replace("'", "''") for r in secrets.MORE}
OP6_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_spans_sql('assign', _ASSIGN)} UNION ALL {_spans_sql('access', 'AKIA[A-Z0-9]+')}
        UNION ALL {_spans_sql('hex', '[0-9a-f]+')}
        {''.join(' UNION ALL ' + _spans_sql(k, p) for k, p in _MORE_SQL.items())}),
spans AS (SELECT doc_id, s.kind AS kind, s.start_ AS start_, s.start_ + length(s.m) AS until FROM raw
          WHERE CASE s.kind WHEN 'assign' THEN length(regexp_extract(s.m, '{_ASSIGN}', 2)) >= 12
                            WHEN 'access' THEN length(s.m) >= 18 WHEN 'hex' THEN length(s.m) >= 16 ELSE true END),
placed AS (SELECT *, list_position(['assign', 'access', 'hex', 'github', 'jwt', 'private_key', 'slack'], kind) AS place FROM spans),
found AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(kind || ':' || start_ || ':' || until, ',' ORDER BY start_, place) FILTER (place <= 3) AS base,
                 string_agg(kind || ':' || start_ || ':' || until, ',' ORDER BY start_, place) AS spans FROM placed GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc_id)
"""


@query("op6_secret_scan", OP6_SQL)
def op6(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "text")
    found = secrets.scan(documents).select("doc_id", "found")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))
    return found.select("doc_id", of("assign"), of("access"), of("hex"),
                        hex_digest(secrets.written(base)).alias("base_sha256"), secrets.written(F.col("found")).alias("spans"))


OP7_SQL = """
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, length(replace(replace(text, '<', '<0'), '[', '[0')) AS n_text,
                 5 + length(replace(replace(role, '<', '<0'), '[', '[0')) AS n_head FROM rows),
placed AS (SELECT *, sum(n_head + n_text + 3) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant'), sum(n_head + n_text + 3)) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


@query("op7_chat_format", OP7_SQL)
def op7(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat.digests(chat.examples(turns.unionByName(more)))


@query("op8_url_filter")
def op8(spark: SparkSession, root: str) -> DataFrame:
    return urls.judge(table(spark, root, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, s AS start_, array_slice(b, s + 1, s + 100) AS w FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS s FROM docs WHERE n >= 100)),
again AS (SELECT doc_id, start_ FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, start_) > 1),
marked AS (SELECT *, CASE WHEN start_ <= lag(start_) OVER (PARTITION BY doc_id ORDER BY start_) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
spans AS (SELECT doc_id, run, min(start_) AS a, max(start_) + 100 AS z FROM
          (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_) AS run FROM marked) GROUP BY ALL),
pieces AS (SELECT doc_id, a, array_slice(b, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, a) AS piece, a = 0 AS none FROM spans JOIN docs USING (doc_id)),
ends AS (SELECT doc_id, max(z) AS z, sum(z - a) AS gone, count(*) AS n_spans FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN none THEN '' ELSE hex(piece) END, '' ORDER BY a) AS h FROM pieces GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN z IS NULL THEN b ELSE unhex(h || CASE WHEN z < n THEN hex(array_slice(b, z + 1, n)) ELSE '' END) END) AS kept_sha256
FROM docs d LEFT JOIN ends USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op9_suffix_dedup", OP9_SQL)
def op9(spark: SparkSession, root: str) -> DataFrame:
    left = suffixes.remove_repeats(table(spark, root, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", hex_digest(F.col("kept")).alias("kept_sha256"))


OP10_SQL = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS code FROM embeddings
                WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query("op10_top_k", OP10_SQL)
def op10(spark: SparkSession, root: str) -> DataFrame:
    return topk.search(table(spark, root, "embeddings"), F.col("id") % 50 == 0)


@query("op11_best_fit_packing")
def op11(spark: SparkSession, root: str) -> DataFrame:
    packed = packing.pack(table(spark, root, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


HEAD = 9  # conversations take over fewer turns than this
GROUP = 5  # from the first of this many ids


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and the keys of all of them.

    A conversation begins with the first h turns of the first of its group of ids, then come its own
    after its first h. Only the few first turns of that other one are joined, once for each of the group.
    """
    rows = settled(turns)
    wanted = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % HEAD
    sizes = rows.groupBy("key").agg(F.max("depth").alias("n"))
    convs = sizes.select("key", wanted("key").alias("h"), (F.col("key") - F.col("key") % GROUP).alias("base"))
    known = convs.join(sizes.select(F.col("key").alias("base"), "n"), "base", "left")
    known = settled(known.select("key", "h", "base", F.least(F.col("h"), F.coalesce("n", F.lit(0))).alias("head")))
    heads = rows.where(F.col("depth") < HEAD).withColumnRenamed("key", "base").join(known.select("key", "base", "h"), "base").where("depth <= h")
    own = rows.where(F.col("depth") > wanted("key")).join(known.select("key", "h", "head"), "key")
    moved = own.withColumn("depth", F.col("depth") - F.col("h") + F.col("head"))
    return heads.select("key", "depth", "id", "size").unionByName(moved.select("key", "depth", "id", "size")), known.select("key")


def _crc_sql(text: str) -> str:
    return _HELD_SQL.replace("CAST(doc_id AS VARCHAR)", text).removesuffix(" % 5 = 0")


OP12_SQL = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
                 ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d
               FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, max(d) AS n, conv_id - conv_id % 5 AS base, {_crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM turns GROUP BY conv_id),
known AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS head FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
made AS (SELECT k.conv_id, t.d, role, text FROM known k JOIN turns t ON t.conv_id = k.base AND t.d <= k.h
         UNION ALL SELECT k.conv_id, t.d - k.h + k.head, role, text FROM known k JOIN turns t ON t.conv_id = k.conv_id AND t.d > k.h),
paths AS (SELECT conv_id, d, octet_length(encode(text)) AS size,
                 string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM made
          UNION ALL SELECT conv_id, 0, 0, '' FROM known),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM paths GROUP BY path, d),
linked AS (SELECT c.*, p.conv_id AS parent FROM nodes c LEFT JOIN nodes p ON c.d > 0 AND p.d = c.d - 1 AND p.path = left(c.path, 64 * (c.d - 1)::INTEGER)),
children AS (SELECT left(path, 64 * (d - 1)::INTEGER) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
wide AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (path)),
below AS (SELECT a.path, sum((b.n - 1) * b.size) AS saved, count(*) FILTER (b.n_children = 0) AS n_leaves
          FROM (SELECT left(path, 64 * k::INTEGER) AS path, n, size, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM wide)) b
          JOIN nodes a USING (path) GROUP BY a.path),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h
         FROM (SELECT conv_id, path FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY path)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM wide JOIN below USING (path) LEFT JOIN ends USING (path)
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, root: str) -> DataFrame:
    return trie.prefix_trie(*rebuilt(trie.ordered(table(spark, root, "conversations"))))


@query("op13_whitening")
def op13(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten(table(spark, root, "embeddings"))
