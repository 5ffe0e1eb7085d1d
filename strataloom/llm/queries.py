"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, leaks, lines, lm, media, minhash, mixing, search, secrets, toxicity, vectors
from .common import read


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(read(spark, sf_dir, "documents"))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(read(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(read(spark, sf_dir, "documents"))


def op11_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_LETTERS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: Exact joins over all pairs that share a shingle or a label, for the small tables that results are compared on.
SQL = {
    "op3_vectors": """with recursive e as (select vec_id, label, embedding::double[] v from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links as (select x.vec_id a, y.vec_id b from e x join e y on x.label = y.label and x.vec_id < y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.98),
 sides as (select a node, b other from links union all select b, a from links), n as (select node, count(*) k from sides group by 1),
 reach(node, r) as (select node, node from (select distinct node from sides) union select s.other, reach.r from reach join sides s on s.node = reach.node), comp as (select node, min(r) c from reach group by 1)
 select vec_id, coalesce(k, 0) n_links, coalesce(c, vec_id) component_id, vec_id = coalesce(c, vec_id) kept from embeddings left join n on n.node = vec_id left join comp on comp.node = vec_id""",
    "op9_minhash": """with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') w from documents),
 sets as (select doc_id, case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end s from words), n as (select doc_id, len(s) n from sets), sh as (select doc_id, unnest(s) s from sets),
 com as (select x.doc_id a, y.doc_id b, count(*) c from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
 links as (select a, b from com join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
 sides as (select a node, b other from links union all select b, a from links),
 reach(node, r) as (select node, node from (select distinct node from sides) union select s.other, reach.r from reach join sides s on s.node = reach.node), comp as (select node, min(r) c from reach group by 1)
 select doc_id, n n_shingles, coalesce(c, doc_id) component_id, doc_id = coalesce(c, doc_id) kept from n left join comp on comp.node = doc_id""",
    "op11_leaks": f"""with d as (select row_number() over () r, doc_id, {_WORDS} w from documents), it as (select item_id::varchar item, {_WORDS} w from benchmark),
 win as (select distinct item, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') s from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from it where len(w) > 0)),
 pl as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') s from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from win) where len(w) >= n)),
 hit as (select r, pl.n, i, item from pl join win using (s)), h as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from hit) group by 1),
 own as (select r, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct r, item from hit where item is not null) group by 1)
 select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join h using (r) left join own using (r)""",
    "op12_search": f"""with d as (select row_number() over () r, doc_id, {_WORDS} w from documents), it as (select item_id, unnest({_WORDS}) t from benchmark),
 tot as (select count(*) big_n, sum(len(w))::bigint big_l from d where len(w) > 0), tf as (select r, t, count(*) tf from (select r, unnest(w) t from d) where t in (select t from it) group by 1, 2),
 wt as (select t, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint w from tf, tot group by t, big_n), m as (select r, doc_id, 75 + (25 * len(w) * big_n) // big_l m from d, tot where len(w) > 0),
 sc as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score from it join tf using (t) join wt using (t) join m using (r) group by 1, 2, 3)
 select item_id, rk::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) rk from sc where score > 0) where rk <= 20""",
    "op13_divergence": f"""with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, {_LETTERS} w from documents),
 tk as (select r, lang, source, unnest(w) term from d), keep as (select lang, term, count(*) n from tk group by 1, 2 having count(distinct r) >= 30),
 g as (select distinct lang, source from d), v as (select lang, count(*) v, sum(n) whole from keep group by 1), c as (select lang, source, term, count(*) c from tk join keep using (lang, term) group by 1, 2, 3), s as (select lang, source, sum(c) total from c group by 1, 2),
 p as (select lang, source, term, coalesce(c, 0) c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 5)) // (coalesce(total, 0) + 5 * v) p, 1 + (1000000000::hugeint * (n + 5)) // (whole + 5 * v) q from g join keep using (lang) join v using (lang) left join s using (lang, source) left join c using (lang, source, term)),
 pr as (select x.lang, x.source, 'pair' as part, y.source item, coalesce((select sum(abs(a.p - b.p)) from p a join p b on a.lang = b.lang and a.term = b.term where a.lang = x.lang and a.source = x.source and b.source = y.source), 0) as value from g x join g y on x.lang = y.lang and x.source <> y.source),
 tm as (select lang, source, 'term' as part, term item, p - q as value from p where c > 0 and p > q), u as (select *, row_number() over (partition by lang, source, part order by value desc, item) rk from (select * from pr union all select * from tm))
 select lang, source, part, item, value::bigint as value, rk::int as rank from u where part = 'pair' or rk <= 50""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
