"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import attribution, decontam, factors, hmm, lines, neighbours, packing, ranked, rules, simhash, toxicity, variants, wavelet
from .common import table
from .vocabularies import byte_bpe, byte_bpe_pattern, word_bpe

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark, sf_dir):
    """Every document in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe(), 2048, 0)


@query
def op6_wavelet_shards(spark, sf_dir):
    """Every document's place, length and checksum, read back from wavelet-matrix files."""
    back = wavelet.round_trip(table(spark, sf_dir, "documents"), word_bpe(), 2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_simhash_near_dedup(spark, sf_dir):
    """Fingerprints of all documents and the groups that links of at most two bits make."""
    near = simhash.near_groups(table(spark, sf_dir, "documents"), 2, 3)
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_quality_rules(spark, sf_dir):
    """Counts of every text, the base rule and the learned verdict."""
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.STATISTICS, "base_failed", "kept", "rule")


@query
def op4_benchmark_decontamination(spark, sf_dir):
    """Every benchmark item of which a document holds 0.8 or more of the five-word shingles."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, 0.8)


#: Lower-cased runs of letters and digits of a text; bytes of other alphabets count as letters.
_LETTER_WORDS = """list_filter(string_split(regexp_replace(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda x: x <> '')"""
_SHINGLES = """SELECT {id} AS id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM (SELECT {id}, {words} AS w
FROM {table})"""
ORACLES["op4_benchmark_decontamination"] = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", words=_LETTER_WORDS.format(text="text"), table="documents")}),
b AS ({_SHINGLES.format(id="item_id", words=_LETTER_WORDS.format(text="text"), table="benchmark")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) / any_value(n.n)::DOUBLE AS containment
FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9
"""


@query
def op9_suffix_array_dedup(spark, sf_dir):
    """Bytes covered by 100-byte strings that start earlier, removed."""
    return factors.digest(table(spark, sf_dir, "documents"), 100)


@query
def op10_line_dedup(spark, sf_dir):
    """Later copies of line runs of ten words or more, removed."""
    return lines.digest(table(spark, sf_dir, "documents"), 10)


def _line_dedup_sql(min_words: int) -> str:
    """Runs of every length n that stand twice or more: one of n + 1 lines is a run of n and the next line's. A run is named by its first place."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
r AS (
  SELECT 1 AS n, doc_id, i, words, words AS total, first_value(doc_id) OVER s AS fd, first_value(i) OVER s AS fi, count(*) OVER (PARTITION BY line) AS times
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l) WINDOW s AS (PARTITION BY line ORDER BY doc_id, i)
  UNION ALL
  SELECT n + 1, doc_id, i, words, total, first_value(doc_id) OVER s, first_value(i) OVER s, count(*) OVER (PARTITION BY fd, fi, nd, ni)
  FROM (SELECT n, doc_id, i, words, words + lead(total) OVER o AS total, fd, fi, lead(fd) OVER o AS nd, lead(fi) OVER o AS ni,
lead(i) OVER o AS j FROM r WHERE times > 1 WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE j = i + 1 WINDOW s AS (PARTITION BY fd, fi, nd, ni ORDER BY doc_id, i)
),
w AS (SELECT doc_id, i, max(n) AS n FROM r WHERE times > 1 AND total >= {min_words} AND (fd <> doc_id OR fi <> i) GROUP BY doc_id, i),
g AS (SELECT l.doc_id, l.i, any_value(l.line) AS line, count(w.i) > 0 AS gone FROM l LEFT
JOIN w ON w.doc_id = l.doc_id AND l.i BETWEEN w.i AND w.i + w.n - 1 GROUP BY l.doc_id, l.i),
b AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM b GROUP BY doc_id
"""


ORACLES["op10_line_dedup"] = _line_dedup_sql(10)


@query
def op3_hidden_markov_scores(spark, sf_dir):
    """Exact likelihood of every text under a hidden Markov model of the training texts, and the unigram base."""
    return hmm.scores(table(spark, sf_dir, "documents"), hmm.fold_is(7, 2))


@query
def op7_token_attribution(spark, sf_dir):
    """Tokens of every stretch of 1000 characters of every document, boundary-crossing ones allotted by the larger part."""
    size = F.char_length(F.coalesce("text", F.lit("")))
    stretch = lambda at: F.struct((at / 1000).cast("long").cast("string").alias("name"), at.cast("long").alias("begin"),
        F.least(at + 1000, size).cast("long").alias("end"))
    docs = table(spark, sf_dir, "documents").withColumn("sections", F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(1000)), stretch))
    return attribution.token_counts(docs, byte_bpe(), byte_bpe_pattern(), "sections")


@query
def op8_neighbour_quality(spark, sf_dir):
    """Quality of every document by the votes of labelled neighbours."""
    return neighbours.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), neighbours.fold_is(5, 0))


@query
def op11_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return ranked.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


ORACLES["op11_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest({_LETTER_WORDS.format(text="text")}) AS t FROM documents),
n AS (SELECT r, count(*) AS n FROM d GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
p AS (SELECT r, doc_id, t, count(*) AS tf FROM d GROUP BY r, doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY t),
q AS (SELECT DISTINCT item_id, unnest({_LETTER_WORDS.format(text="text")}) AS t FROM benchmark),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
FROM q JOIN w USING (t) JOIN p USING (t) JOIN n USING (r), total GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query
def op12_spelling_variants(spark, sf_dir):
    """Every word of five code points and three occurrences with its frequent neighbour and the last form it goes back to."""
    return variants.spelling_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 byte by byte over UTF-8 (characters below U+0800); neighbours meet by the pattern of all but one character.
ORACLES["op12_spelling_variants"] = """
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
FROM (SELECT unnest(range(0, 256)) AS b)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[a-zÀ-ÿ]+')) AS run FROM documents),
pairs AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END)) AS bs FROM pairs),
h AS (SELECT run, n, xor(list_reduce(bs, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
results AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS less, substr(word, 1, i - 1) || substr(word, i + 1) AS bare
FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM p a JOIN p b ON a.less = b.less AND a.word <> b.word
  UNION SELECT DISTINCT p.word, w.word, w.n FROM p JOIN w ON p.bare = w.word
  UNION SELECT DISTINCT w.word, p.word, p.n FROM p JOIN w ON p.bare = w.word
),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""


@query
def op13_toxicity(spark, sf_dir):
    """Toxicity of every document by a model that is held to the same score when names of groups are swapped."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.fold_is(3, 1), 0.7)
