"""Queries over the document texts: keywords, phrases, fingerprints, near-duplicates, keyword sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import lookups as L
from rankloom.catalog.fixtures import fx_docs, fx_pages
from rankloom.catalog.page_queries import P, _sql_list, competition_sql, intent_sql
from rankloom.catalog.registry import once, query
from rankloom.functions import text as TX
from rankloom.operators import keyword_sets as KS, near_duplicates as ND, text_mining as TM

D = ("fx_docs",)
TOK = "tok AS (select doc_id, unnest(regexp_extract_all(body_text, '[a-z]{3,}')) as term from fx_docs), tf AS (select doc_id, term, count(*) as tf from tok group by 1, 2)"
TFIDF = f"""{TOK}, voc AS (select term, sum(tf) as total, count(*) as df from tf group by 1), nd AS (select count(*) as n from fx_docs),
 w AS (select doc_id, term, (1 + ln(cast(tf as double))) * (ln((1.0 + n) / (1.0 + df)) + 1) as w from tf join voc using (term), nd),
 u AS (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from w)"""


@query("txt_01_tfidf_keywords", D, f"""WITH {TFIDF}, b AS (select *, row_number() over (partition by doc_id order by round(weight, 9) desc, term) as r from u qualify r <= 20)
 select doc_id, cast(row_number() over (partition by doc_id order by r) as int) as rank, term, round(weight, 4) as weight from b where term not in {_sql_list(L.TERM_STOPWORDS)} qualify rank <= 10""")
def _(spark, sf):
    out = TM.tfidf_keywords(fx_docs(spark, sf), F.col("text"), "doc_id")
    return out.select("doc_id", "rank", "term", F.round("weight", 4).alias("weight"))


@query("win_07_top_terms", D, f"WITH {TFIDF} select doc_id, term, cast(row_number() over (partition by doc_id order by round(weight, 9) desc, term) as int) as rank from u qualify rank <= 3")
def _(spark, sf):
    out = TM.tfidf_keywords(fx_docs(spark, sf), F.col("text"), "doc_id", k=3, stopwords=["-"])
    return out.select("doc_id", "term", "rank")


@query("txt_02_frequent_keywords", D, f"WITH {TOK} select doc_id, term, tf, cast(row_number() over (partition by doc_id order by tf desc, term) as int) as rank from tf where term not in {_sql_list(L.TERM_STOPWORDS)} qualify rank <= 10")
def _(spark, sf):
    return TM.frequent_keywords(fx_docs(spark, sf), F.col("text"), "doc_id")


WL = f"wl AS (select doc_id, list_filter(regexp_extract_all(body_text, '[a-z]{{3,}}'), lambda w: w not in {_sql_list(L.PHRASE_STOPWORDS)}) as w from fx_docs)"


@query("txt_03_phrases", D, f"""WITH {WL}, g AS (select doc_id, concat(w[i], ' ', w[i + 1]) as phrase, 2 as k from (select doc_id, w, unnest(range(1, len(w))) as i from wl) a
 UNION ALL select doc_id, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]), 3 from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from wl where len(w) > 2) b),
 c AS (select doc_id, phrase, k, count(*) as n from g group by 1, 2, 3), b AS (select *, row_number() over (partition by doc_id order by n desc, phrase) as r from c qualify r <= 20)
 select doc_id, cast(row_number() over (partition by doc_id order by r) as int) as rank, phrase, n from b where n >= 2 or k = 3 qualify rank <= 10""")
def _(spark, sf):
    return TM.phrases(fx_docs(spark, sf), F.col("text"), "doc_id")


WT = f"""pw AS (select url, list_filter(regexp_extract_all(lower(concat_ws(' ', title, title, title, array_to_string(h1, ' '), array_to_string(h1, ' '), body_text)), '[a-z]{{3,}}'), lambda w: w not in {_sql_list(L.FIELD_STOPWORDS)}) as w from fx_pages where not is_error and body_text <> ''),
 s AS (select url, keyword, count(*) as freq from (select url, unnest(w) as keyword from pw) a group by 1, 2),
 b AS (select url, concat(w[i], ' ', w[i + 1]) as keyword, count(*) as freq from (select url, w, unnest(range(1, len(w))) as i from pw) a group by 1, 2 having count(*) >= 2),
 ub AS (select distinct url, unnest(string_split(keyword, ' ')) as keyword from b),
 wt AS (select *, cast(row_number() over (partition by url order by freq desc, keyword) as int) as rank from (select * from b UNION ALL select s.* from s anti join ub using (url, keyword)) x qualify rank <= 10)"""


@query("txt_04_weighted_terms", P, f"WITH {WT} select url, keyword, freq, rank from wt")
def _(spark, sf):
    return TM.weighted_terms(fx_pages(spark, sf).where("not is_error and body_text <> ''"))


def suggestions(pages):
    """Suggestions per page: its keywords, each continued."""
    return pages.select("url", F.transform("keywords", lambda k: F.concat(k, F.lit(" online"))).alias("suggestions"))


def positions(pages):
    """A result position for the first keyword of each page."""
    return pages.select("url", F.get("keywords", F.lit(0)).alias("keyword"), (F.length("url") % 30 + 1).alias("position")).where("keyword is not null")


def _in(text):
    return f"regexp_matches({text}, concat('(^|[^\\p{{L}}\\p{{N}}_])', keyword, '($|[^\\p{{L}}\\p{{N}}_])'))"


def _squeeze(x):
    return f"lower(trim(regexp_replace({x}, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')))"


IMPORTANCE = f"""{WT}, tx AS (select url, keywords, {_squeeze('title')} as t, {_squeeze("array_to_string(h1, ' ')")} as a, {_squeeze("array_to_string(h2, ' ')")} as b, {_squeeze("array_to_string(h3, ' ')")} as c, {_squeeze('body_text')} as body,
 array_to_string(regexp_extract_all(lower(body_text), '[a-z]{{3,}}')[1:100], ' ') as head, length(url) % 30 + 1 as pos from fx_pages),
 j AS (select wt.url, wt.keyword, wt.freq, case when {_in('t')} or {_in('a')} then 3 else 0 end + case when {_in('b')} or {_in('c')} then 2 else 0 end + case when freq > 5 then 2 else 0 end
  + case when len(list_filter(keywords, lambda k: {_in("concat(k, ' online')")})) > 0 then 3 else 0 end as score, {_in('head')} as prominent, round(100.0 * len(regexp_extract_all(concat(' ', replace(body, ' ', '  '), ' '), concat('[^\\p{{L}}\\p{{N}}_]', replace(keyword, ' ', '  '), '[^\\p{{L}}\\p{{N}}_]'))) / greatest(len(regexp_extract_all(body, '[a-z]{{3,}}')), 1), 2) as density, case when keyword = keywords[1] then pos end as serp_position from wt join tx using (url))"""
_CTR_VALUES = ", ".join(f"({p}, {c}, '{t}')" for p, c, t in L.CTR_CURVE)


@query("txt_05_keyword_importance", P, f"""WITH {IMPORTANCE}, cv AS (select * from (values {_CTR_VALUES}) v(p, ctr, tier)) select url, keyword, freq, cast(score as int) as score, case when score >= 6 then 'HIGH' when score >= 3 then 'MEDIUM' else 'LOW' end as importance, prominent, density,
 cast(serp_position as int) as serp_position, case when serp_position is not null then round(coalesce(cast(ctr as double) / 100, 0.002), 4) end as expected_ctr, case when serp_position is not null then coalesce(tier, 'below') end as ctr_tier from j left join cv on cv.p = j.serp_position""")
def _(spark, sf):
    pages = fx_pages(spark, sf)
    out = TM.keyword_importance(pages, suggestions=suggestions(pages), positions=positions(pages))
    return out.select("url", "keyword", "freq", "score", "importance", "prominent", "density", "serp_position", "expected_ctr", "ctr_tier")


# --- fingerprints -----------------------------------------------------------------------------------------------------

FP = """th AS (select doc_id, ('0x' || substr(md5(t), 1, 16))::ubigint as h from (select doc_id, unnest(regexp_extract_all(body_text, '[a-z0-9]{3,}')) as t from fx_docs) a),
 bits AS (select doc_id, i, sum(cast((h >> i::ubigint) & 1::ubigint as bigint)) as ones, count(*) as n from th, range(64) r(i) group by 1, 2),
 fps AS (select doc_id, sum(case when 2 * ones > n then (1::hugeint << i::hugeint) else 0::hugeint end) as f from bits group by 1),
 fp AS (select doc_id, f::ubigint as f, cast(case when f >= 9223372036854775808 then f - 18446744073709551616 else f end as bigint) as fp from fps where f <> 0),
 gr AS (select f, fp, min(doc_id) as first, count(*) as members from fp group by 1, 2)"""


def prints(spark, sf):
    return once(spark, sf, "fingerprints", lambda: ND.fingerprints(fx_docs(spark, sf), F.col("text"), "doc_id"))


@query("fn_04_fingerprint", D, f"WITH {FP} select doc_id, fp from fp")
def _(spark, sf):
    return prints(spark, sf)


def _pair_sql(condition):
    return f"select a.first as a_doc, b.first as b_doc, a.f as fa, b.f as fb, a.members as na, b.members as nb, bit_count(xor(a.f, b.f)) as d from gr a join gr b on a.first < b.first where {condition}"


@query("fn_05_similarity_to_first", D, f"WITH {FP}, z AS (select f from fp order by doc_id limit 1) select doc_id, cast(bit_count(xor(fp.f, z.f)) as int) as distance, round(1 - bit_count(xor(fp.f, z.f)) / cast(64 as double), 4) as similarity from fp, z")
def _(spark, sf):
    docs = prints(spark, sf)
    first = F.lit(docs.orderBy("doc_id").head()["fp"])
    return docs.select("doc_id", TX.hamming(F.col("fp"), first).alias("distance"), TX.similarity(F.col("fp"), first).alias("similarity"))


_MASKS = " or ".join(f"(xor(a.f, b.f) & {m if m >= 0 else m + (1 << 64)}::ubigint) = 0" for m in ND.block_masks(3))


@query("txt_06_candidate_pairs", D, f"WITH {FP} select least(a.fp, b.fp) as fp_a, greatest(a.fp, b.fp) as fp_b from gr a join gr b on a.first < b.first where {_MASKS}")
def _(spark, sf):
    return ND.candidate_pairs(ND.groups(prints(spark, sf), "doc_id").select("fp"))


@query("txt_07_exact_duplicates", D, f"WITH {FP} select first as url_a, doc_id as url_b, members from fp join gr using (f) where doc_id <> first")
def _(spark, sf):
    return ND.exact_duplicates(prints(spark, sf), "doc_id").select("url_a", "url_b", "members")


def near(spark, sf):
    return once(spark, sf, "near-pairs", lambda: ND.near_pairs(prints(spark, sf), 3, "doc_id"))


@query("txt_07_near_duplicates", D, f"""WITH {FP}, p AS ({_pair_sql('bit_count(xor(a.f, b.f)) <= 3')}) select a_doc as url_a, b_doc as url_b, na as members_a, nb as members_b, cast(d as int) as hamming_distance, round(1 - d / cast(64 as double), 4) as similarity,
 case when d <= 1 then 'exact' else 'near_duplicate' end as risk_level from p""")
def _(spark, sf):
    return near(spark, sf)


@query("txt_07_duplicate_summary", D, f"""WITH {FP}, p AS ({_pair_sql('bit_count(xor(a.f, b.f)) <= 3')}), e AS (select cast(sum(members) as bigint) as documents, cast(sum(members * (members - 1) / 2) as bigint) as eq from gr),
 c AS (select cast(coalesce(sum(na * nb) filter (d <= 1), 0) as bigint) as ex, cast(coalesce(sum(na * nb) filter (d > 1), 0) as bigint) as nr from p) select documents, eq + ex + nr as duplicate_pairs, eq + ex as exact_duplicates, nr as near_duplicates from e, c""")
def _(spark, sf):
    renamed = prints(spark, sf).withColumnRenamed("doc_id", "url")
    return ND.duplicate_summary(renamed, near(spark, sf))


@query("txt_08_site_similarity", D, """WITH tf AS (select site, term, count(*) as tf from (select site, unnest(regexp_extract_all(body_text, '[a-z]{3,}')) as term from fx_docs) t group by 1, 2), ns AS (select count(distinct site) as n from fx_docs),
 voc AS (select term, sum(tf) as total, count(*) as df from tf group by 1), w AS (select site, term, (1 + ln(cast(tf as double))) * (ln((1.0 + n) / (1.0 + df)) + 1) as w from tf join voc using (term), ns),
 o AS (select term, w as tw from w where site = 'src0'), q AS (select sqrt(sum(tw * tw)) as q from o) select site, round(100 * sum(w * coalesce(tw, 0)) / (sqrt(sum(w * w)) * any_value(q)), 1) as similarity from w left join o using (term), q where site <> 'src0' group by site""")
def _(spark, sf):
    return TM.site_similarity(fx_docs(spark, sf), F.col("text"), "src0")


# --- keyword sets -----------------------------------------------------------------------------------------------------

def site_keywords(spark, sf):
    """Frequent terms of each document as the keywords of its source."""
    def build():
        docs = fx_docs(spark, sf)
        terms = TM.frequent_keywords(docs, F.col("text"), "doc_id")
        return terms.join(docs.select("doc_id", "site"), "doc_id").select("site", "doc_id", F.col("term").alias("keyword"), "rank")

    return once(spark, sf, "site-keywords", build)


SK = f"""{TOK}, ft AS (select doc_id, term, row_number() over (partition by doc_id order by tf desc, term) as rank from tf where term not in {_sql_list(L.TERM_STOPWORDS)} qualify rank <= 10), sk AS (select d.site, f.doc_id, f.term as keyword, f.rank from ft f join fx_docs d using (doc_id))"""


@query("set_02_keyword_gap", D, f"""WITH {SK}, y AS (select distinct keyword from sk where site = 'src0'), t AS (select distinct keyword from sk where site = 'src1')
 select coalesce(y.keyword, t.keyword) as keyword, case when y.keyword is null then 'missing' when t.keyword is null then 'strong' else 'weak' end as type, case when y.keyword is null then 75 when t.keyword is null then 15 else 40 end as gap_score from y full join t on y.keyword = t.keyword""")
def _(spark, sf):
    rows = site_keywords(spark, sf)
    return KS.keyword_gap(rows.where("site = 'src0'"), rows.where("site = 'src1'"))


@query("set_03_competitor_gap", D, f"""WITH {SK}, p AS (select distinct site, keyword from sk), n AS (select count(distinct site) as n from p where site <> 'src0'),
 g AS (select keyword, count(*) filter (site <> 'src0') as c, bool_or(site = 'src0') as own from p where length(keyword) > 3 group by 1)
 select keyword, c as competitor_count, round(least(c / cast(n as double) * 70 + 10, 100), 1) as opportunity_score, {intent_sql('keyword')} as intent from g, n where not own and c >= 2 order by 2 desc, 3 desc, 1 limit 50""")
def _(spark, sf):
    return KS.competitor_gap(site_keywords(spark, sf), "src0")


def rivals(pages):
    """Each page competes with the page its canonical or its next page names."""
    other = pages.select(F.col("url").alias("rival_url"), F.col("keywords").alias("rival_keywords"),
                         F.coalesce(F.get("h1", F.lit(0)), F.lit("")).alias("rival_h1"), F.col("title").alias("rival_title"))
    ends = pages.select("url", F.explode(F.array_distinct(F.array("canonical", "pagination_next", "pagination_prev"))).alias("rival_url"))
    return ends.where("rival_url <> url and rival_url <> ''").join(other, "rival_url")


RIV = """en AS (select distinct url, r from (select url, unnest([canonical, pagination_next, pagination_prev]) as r from fx_pages) t where r <> url and r <> ''),
 rv AS (select en.url, p.url as rival_url, p.keywords as ks, coalesce(p.h1[1], '') as h1, p.title from en join fx_pages p on p.url = en.r)"""


@query("set_04_page_gap", P, f"""WITH {RIV}, k AS (select url, keyword, count(*) as n from (select distinct url, rival_url, lower(unnest(ks)) as keyword from rv) t group by 1, 2), t AS (select *, row_number() over (partition by url order by n desc, keyword) as r from k qualify r <= 10),
 m AS (select t.*, row_number() over (partition by t.url order by t.r) as q from t join fx_pages p using (url) where not list_contains(list_transform(p.keywords, lambda x: lower(x)), t.keyword) and length(t.keyword) > 3 qualify q <= 5)
 select url, string_agg(keyword, '|' order by q) as missing_keywords from m group by url""")
def _(spark, sf):
    pages = fx_pages(spark, sf)
    return KS.page_gap(pages, rivals(pages)).withColumn("missing_keywords", F.array_join("missing_keywords", "|"))


@query("set_04_heading_gap", P, f"""WITH {RIV}, f AS (select url, min_by(h1, rival_url) filter (h1 <> '') as h1, min_by(title, rival_url) filter (title <> '') as title, count(*) as n from rv group by 1)
 select p.url, case when trim(array_to_string(p.h1, ' ')) = '' then coalesce(f.h1, '') else '' end as h1_gap, case when trim(p.title) = '' then coalesce(f.title, '') else '' end as title_gap, coalesce(f.n, 0) as competitor_count from fx_pages p left join f using (url)""")
def _(spark, sf):
    pages = fx_pages(spark, sf)
    return KS.heading_gap(pages, rivals(pages))


@query("set_05_merged_keywords", P, """select url, array_to_string(d[1:15], '|') as keywords from
 (select url, m, list_filter(list_transform(range(1, len(m) + 1), lambda i: case when list_position(m, m[i]) = i and m[i] <> '' then m[i] end), lambda x: x is not null) as d from
 (select url, list_transform(list_concat(keywords, h2, list_transform(keywords, lambda k: concat(' ', k, ' online'))), lambda x: lower(trim(x))) as m from fx_pages) t) u""")
def _(spark, sf):
    third = F.transform("keywords", lambda k: F.concat(F.lit(" "), k, F.lit(" online")))
    return fx_pages(spark, sf).select("url", F.array_join(KS.merge_keywords(F.col("keywords"), F.col("h2"), third), "|").alias("keywords"))


ENRICHED = f"""ld AS (select *, lower(concat_ws(' ', title, title, title, array_to_string(h1, ' '), array_to_string(h1, ' '), meta_description, array_to_string(h2, ' '), body_text)) as tx from fx_pages where not is_error and status_code = 200 and body_text <> ''),
 ptf AS (select url, term, count(*) as tf from (select url, unnest(regexp_extract_all(tx, '[a-z]{{3,}}')) as term from ld) t group by 1, 2), pvoc AS (select term, sum(tf) as total, count(*) as df from ptf group by 1), pn AS (select count(*) as n from ld),
 pwt AS (select url, term, (1 + ln(cast(tf as double))) * (ln((1.0 + n) / (1.0 + df)) + 1) as w from ptf join pvoc using (term), pn), pu AS (select url, term, w / sqrt(sum(w * w) over (partition by url)) as weight from pwt),
 pb AS (select *, row_number() over (partition by url order by round(weight, 9) desc, term) as r from pu qualify r <= 20), pt AS (select url, list(term order by r) as terms from (select *, row_number() over (partition by url order by r) as q from pb where term not in {_sql_list(L.TERM_STOPWORDS)} qualify q <= 10) x group by 1),
 pl AS (select url, list_filter(regexp_extract_all(lower(body_text), '[a-z]{{3,}}'), lambda w: w not in {_sql_list(L.PHRASE_STOPWORDS)}) as w from ld),
 pg AS (select url, concat(w[i], ' ', w[i + 1]) as phrase, 2 as k from (select url, w, unnest(range(1, len(w))) as i from pl) a UNION ALL select url, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]), 3 from (select url, w, unnest(range(1, len(w) - 1)) as i from pl where len(w) > 2) b),
 pc AS (select url, phrase, k, count(*) as n from pg group by 1, 2, 3), pr AS (select *, row_number() over (partition by url order by n desc, phrase) as r from pc qualify r <= 16),
 pp AS (select url, list(phrase order by r) as phrases from (select *, row_number() over (partition by url order by r) as q from pr where n >= 2 or k = 3 qualify q <= 8) x group by 1),
 pm AS (select ld.url, list_concat(coalesce(pt.terms, []), coalesce(pp.phrases, []), list_transform(ld.keywords, lambda k: lower(trim(concat(k, ' online'))))) as m from ld left join pt using (url) left join pp using (url)),
 pk AS (select url, list_filter(list_transform(range(1, len(m) + 1), lambda i: case when list_position(m, m[i]) = i and m[i] <> '' then m[i] end), lambda x: x is not null)[1:15] as ks from pm)"""


@query("txt_09_keyword_enrichment", P, f"""WITH {ENRICHED}, {WT}, sc AS (select url, count(*) as n from wt group by 1)
 select pk.url, array_to_string(ks, '|') as keywords, {competition_sql('ks')} as competition, cast(coalesce(sc.n, 0) as int) as scored from pk left join sc using (url)""")
def _(spark, sf):
    from rankloom.plans.keyword_enrichment import enrich_keywords

    pages = fx_pages(spark, sf)
    out = enrich_keywords(pages, suggestions(pages), positions(pages))
    return out.select("url", F.array_join("keywords", "|").alias("keywords"), "competition", F.coalesce(F.size("keywords_scored"), F.lit(0)).alias("scored"))
