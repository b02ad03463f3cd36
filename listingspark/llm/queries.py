"""The numbered corpus queries, each a thin layer over its operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.binrecords import token_records
from listingspark.llm.cleaning import BOILERPLATE, LEADS_ON, MENU_WORDS, SENTENCE_ENDS, SEPARATORS, clean_lines
from listingspark.llm.common import read
from listingspark.llm.decontam import find_leaks
from listingspark.llm.linededup import drop_shared_lines
from listingspark.llm.lm import score_language
from listingspark.llm.mixing import mix_to_weights
from listingspark.llm.neardup import near_duplicates
from listingspark.llm.prefixtrie import numbered, prefix_trie, share_heads
from listingspark.llm.quality import score_quality
from listingspark.llm.secretscan import joined, scan_secrets
from listingspark.llm.toxicity import score_toxicity
from listingspark.llm.warc import archive_pages
from listingspark.llm.whitening import whiten

#: The vocabulary of op8; any file of the tokenizers library serves.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of the ids is held out."""
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the ids is held out."""
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at 0.85, over all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and model findings in every document."""
    found = scan_secrets(read(spark, sf_dir, "documents"))
    spans = F.array_sort(F.concat("base_spans", "random_spans"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; a tenth of the ids is held out."""
    return score_language(read(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the weights 5, 2, 1 over all documents, three copies at most."""
    mixed = mix_to_weights(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    cleaned = clean_lines(read(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record of token ids, read back from the files."""
    return token_records(read(spark, sf_dir, "documents"), vocabulary_path(), end_id=1)


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an archive record, read back from the archives."""
    return archive_pages(read(spark, sf_dir, "pages")).drop("url")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark item."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more that five documents hold stay in the last of them."""
    cut = drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the conversations, whose first turns come from the first of each twenty."""
    return prefix_trie(share_heads(numbered(read(spark, sf_dir, "conversations"))))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen first whitened components of every usable vector."""
    return whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    found = [
        op1_quality,
        op2_toxicity,
        op3_minhash_near_dedup,
        op4_secret_scan,
        op5_language_model,
        op6_mix_sources,
        op7_line_cleaning,
        op8_token_records,
        op9_warc_archives,
        op10_decontaminate,
        op11_line_dedup,
        op12_conversation_trie,
        op13_embedding_whitening,
    ]
    return {f.__name__: f for f in found}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select distinct doc_id, case when len(w) < 3 then w else w[i:i+2] end as s
  from words, lateral (select unnest(range(1, greatest(len(w) - 1, 2))) as i)
  where len(w) > 0
), sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n
  having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach as (
  select doc_id as root, doc_id as node from documents
  union
  select r.root, l.b from reach r join links l on l.a = r.node
), lowest as (select node, min(root) as component_id from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join lowest on node = d.doc_id
"""

OP6_SQL = rf"""
with sized as (
  select doc_id, source, len({WORDS}) as size,
    ('0x' || substr(md5(concat(coalesce(cast(doc_id as varchar), ''), '|', coalesce(text, ''))), 1, 15))::bigint as hash
  from documents
), totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (
  select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, 3 * source_size as cap from totals
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from ranked
), chosen as (
  select coalesce(arg_min(level, cap / weight) filter (level * weight <= cap), max(level)) as level from levels
), targets as (
  select source, source_size, least(cap::double, chosen.level * weight) as target from levels, chosen
), budgets as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets
), run as (
  select s.doc_id, s.source, s.size, s.hash, b.source_size, b.target, b.whole,
    b.target - b.whole * b.source_size as budget,
    sum(s.size) over (partition by s.source order by s.hash range unbounded preceding) as upto,
    sum(s.size) over (partition by s.source, s.hash) as own
  from sized s join budgets b on s.source is not distinct from b.source
)
, ends as (
  select *, min(case when upto > budget then hash end) over (partition by source) as edge from run
)
select doc_id, size, source_size, target,
  cast(size * (whole + case when budget > 0 and (hash < edge or (hash = edge and own - (budget - (upto - own)) <= budget - (upto - own))) then 1 else 0 end) as bigint) as taken
from ends
"""

_QUOTED = lambda x: x.replace("'", "''")
_APART = " + ".join(f"len(string_split(x, '{m}')) - 1" for m in SEPARATORS)
_LEADS = " or ".join(f"ends_with(bare, '{m}')" for m in LEADS_ON)
_FURNITURE = " or ".join(f"contains(low, '{_QUOTED(p)}')" for p in BOILERPLATE)

OP7_SQL = rf"""
with base as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select doc_id, i, w[i:i+4] as g from base, lateral (select unnest(range(1, len(w) - 3)) as i) where len(w) >= 5
), twins as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from windows) where c > 1
), covered as (
  select doc_id, count(distinct i + k) as repeated from twins, (select unnest(range(0, 5)) as k) group by doc_id
), firsts as (
  select doc_id, x, min(p) as p from (select doc_id, unnest(lines) as x, generate_subscripts(lines, 1) as p from base) group by doc_id, x
), judged as (
  select doc_id, x, lower(x) as low, rtrim(translate(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) as bare,
    length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) as solid,
    length(x) - length(translate(x, '#*$%&|<>', '')) as symbols,
    length(x) - length(replace(x, '!', '')) as shouted,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n
  from firsts
), stays as (
  select doc_id, sum(solid) as left_chars from judged
  where not (symbols * 10 > solid or (shouted > 3 and shouted * 3 > n) or (n <= 12 and ({_LEADS})) or ({_APART}) * 5 > n
    or (n <= {MENU_WORDS} and not contains('{_QUOTED(SENTENCE_ENDS)}', right(bare, 1))) or {_FURNITURE})
  group by doc_id
), measured as (
  select b.doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(repeated, 0) as n_repeat_words, coalesce(left_chars, 0) as left_chars
  from base b left join covered c on c.doc_id = b.doc_id left join stays s on s.doc_id = b.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or n_repeat_words > 0.2 * n_words) as base_failed,
  not (n_words < 10 or n_repeat_words > 0.2 * n_words)
    and (case when word_chars > 0 then 1 - left_chars::double / word_chars else 0 end) <= 0.5 as kept
from measured
"""

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 10 * g}, 10))::bigint >> {35 - 5 * k}) & 31)::int, 1)"
    for g in range(4)
    for k in range(8)
)
OP9_SQL = f"""
with payloads as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages
), firsts as (
  select *, max(page_id) over (partition by h, payload_bytes) as response from payloads
)
select page_id, payload_bytes, {_DIGITS} as payload_digest,
  case when page_id = response then 'response' else 'revisit' end as record_type,
  case when page_id <> response then response end as refers_to
from firsts
"""

OP11_SQL = r"""
with rows as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as x, generate_subscripts(lines, 1) as p from rows),
keyed as (
  select doc_id, p, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), shared as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), judged as (select doc_id, p, x, coalesce(keeper <> doc_id, false) as gone from keyed left join shared using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(x, chr(10) order by p) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

# crc32 by bits: the last two of a decimal id's checksum choose how many turns are shared
OP12_SQL = r"""
with recursive bits as (select i, i as c, 0 as step from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from bits where step < 8),
entry as (select i, c from bits where step = 8),
ids as (select distinct conv_id, cast(conv_id as varchar) as s from conversations where conv_id is not null),
crc as (
  select conv_id, s, cast(4294967295 as bigint) as c, 0 as n from ids
  union all
  select crc.conv_id, crc.s, xor(crc.c >> 8, entry.c), n + 1 from crc join entry on entry.i = xor(crc.c & 255, ascii(substr(crc.s, n + 1, 1))) where n < length(crc.s)
), h as (select conv_id, conv_id - conv_id % 20 as first, xor(c, 4294967295) % 4 as h from crc where n = length(s)),
numbered as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), rebuilt as (
  select h.conv_id, p, 0 as own, role, text from h join numbered n on n.conv_id = h.first and p <= h
  union all select h.conv_id, p, 1, role, text from h join numbered n on n.conv_id = h.conv_id and p > h
), turns as (select conv_id, row_number() over (partition by conv_id order by own, p) as d, concat(length(role), ':', role, text) as turn, text from rebuilt),
paths as (
  select conv_id, cast(0 as bigint) as d, '' as path, cast(0 as bigint) as w from h
  union all
  select paths.conv_id, turns.d, sha256(concat(paths.path, turns.turn)), len(regexp_extract_all(turns.text, '[^\x20\x09-\x0D]+')) from paths join turns on turns.conv_id = paths.conv_id and turns.d = paths.d + 1
), lasts as (select conv_id, max(d) as last from paths group by 1),
nodes as (
  select d, path, min(paths.conv_id) as conv_id, count(*) as n_convs, max(w) as w, max(last) as longest,
    coalesce(string_agg(cast(paths.conv_id as varchar), ',' order by paths.conv_id) filter (last = d), '') as ends
  from paths join lasts on lasts.conv_id = paths.conv_id group by d, path
), above as (
  select n.d, n.path, p.d as up, p.path as up_path, n.w * (n.n_convs - 1) as cost, cast(n.longest = n.d as int) as leaf
  from nodes n join paths p on p.conv_id = n.conv_id and p.d <= n.d
), trees as (select up as d, up_path as path, sum(cost) as saved, sum(leaf) as leaves, count(*) filter (above.d = up + 1) as children from above group by 1, 2)
select n.conv_id, n.d as depth, m.conv_id as parent_conv_id, n.n_convs, children as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join trees t on t.d = n.d and t.path = n.path
  left join paths p on p.conv_id = n.conv_id and p.d = n.d - 1 left join nodes m on m.d = p.d and m.path = p.path
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_line_dedup": OP11_SQL,
        "op12_conversation_trie": OP12_SQL,
        "op3_minhash_near_dedup": OP3_SQL,
        "op6_mix_sources": OP6_SQL,
        "op7_line_cleaning": OP7_SQL,
        "op9_warc_archives": OP9_SQL,
    }
