"""Queries of attribution, scores, factor risk and retrieval, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import portfolio, retrieval
from tidemark.plans.series_queries import PRICES, RETURNS, _daily, _r, prices
from tidemark.session import table


def _sides(spark, sf):
    """Portfolio: urgent orders; benchmark: all.  Weights are revenue shares, returns relative prices of the region."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("period"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).select("period", (F.col("l_suppkey") % 7).alias("grp"), "o_orderpriority", "l_extendedprice", "l_quantity", "l_discount")

    def side(x):
        g = x.groupBy("period", "grp").agg(F.sum("l_extendedprice").alias("v"), F.avg("l_discount").alias("r"))
        return g.join(g.groupBy("period").agg(F.sum("v").alias("t")), "period").select("period", "grp", (F.col("v") / F.col("t")).alias("w"), "r")

    return side(j.filter("o_orderpriority = '1-URGENT' and grp != 3")), side(j)


def brinson_by_period(spark, sf):
    return _r(portfolio.brinson(*_sides(spark, sf), "period", "grp"), 9, "allocation", "selection", "interaction", "contribution", "benchmark_contribution")


def carino_linked(spark, sf):
    return _r(portfolio.linked(portfolio.brinson(*_sides(spark, sf), "period", "grp"), "period", "grp"), 9, "allocation", "selection", "interaction")


def transaction_cost(spark, sf):
    p = table(spark, sf, "part")
    notional, adv = F.col("p_retailprice") * F.col("p_size"), F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice") * 40)
    bps = portfolio.cost_bps(notional, adv, F.col("p_size") / 50.0, F.lit(0.5))
    return p.select("p_partkey", F.round(bps, 7).alias("bps"), F.round(2 * bps, 7).alias("round_trip_bps"), F.round(notional * bps / 1e4, 6).alias("cost"))


def tradeability_pct(spark, sf):
    c = table(spark, sf, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 9 != 0, F.round(F.col("p_retailprice"), 0)).alias("cost"))
    return _r(portfolio.tradeability(c, ["p_brand"], "cost"), 6, "tradeability")


_PILLARS = {"quality": 0.3, "value": 0.2, "momentum": 0.2, "growth": 0.2, "stewardship": 0.05, "defensiveness": 0.05}


def attractiveness(spark, sf):
    p = table(spark, sf, "part")
    legs = {"quality": F.col("p_retailprice"), "value": -F.col("p_size").cast("double"), "momentum": (F.col("p_partkey") * 31 % 101).cast("double"), "growth": F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") * 17 % 53).cast("double")), "stewardship": F.lit(1.0), "defensiveness": F.length("p_name").cast("double")}
    long = p.select("p_brand", "p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("pillar"), v.cast("double").alias("v")) for k, v in legs.items()])).alias("x")).select("p_brand", "p_partkey", "x.*")
    return _r(portfolio.attractiveness(long, ["p_brand"], "p_partkey", "pillar", "v", _PILLARS), 6, "composite", "score")


def _panel(spark, sf):
    d = _daily(spark, sf).filter("ret is not null")
    m = d.groupBy("date").agg(F.avg("ret").alias("market"))
    return d.join(m, "date")


def beta_ols_single(spark, sf):
    out = portfolio.least_squares(_panel(spark, sf), "symbol", "ret", ["market"])
    return out.select("symbol", "n", F.round("intercept", 6).alias("intercept"), F.round(F.col("betas")[0], 6).alias("beta"), F.round("resid_var", 6).alias("resid_var"))


def factor_model(spark, sf):
    """Two factors; the oracle solves the normal equations by Cramer's rule."""
    x = _panel(spark, sf).withColumn("season", F.sin(F.dayofyear("date") / 58.0))
    out = portfolio.least_squares(x, "symbol", "ret", ["market", "season"])
    return out.select("symbol", "n", F.round(F.col("betas")[0], 5).alias("b_market"), F.round(F.col("betas")[1], 5).alias("b_season"))


def _numeric(spark, sf):
    return table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")


def factor_covariance(spark, sf):
    return _r(portfolio.covariance(_numeric(spark, sf), ["l_quantity", "l_discount", "l_tax"]), 9, "v")


def shrunk_covariance(spark, sf):
    return _r(portfolio.covariance(_numeric(spark, sf), ["l_quantity", "l_discount", "l_tax"], "ledoit_wolf"), 9, "v")


def _model(spark, sf):
    s = table(spark, sf, "supplier")
    w = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"), F.col("s_acctbal").alias("w"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ticker")).agg(F.avg("l_discount").alias("l_discount"), F.avg("l_tax").alias("l_tax"), F.var_pop("l_discount").alias("d"))
    betas = li.select("ticker", F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("b")) for c in ("l_discount", "l_tax")])).alias("x")).select("ticker", "x.*")
    cov = portfolio.covariance(_numeric(spark, sf), ["l_discount", "l_tax"]).select(F.col("i").alias("f1"), F.col("j").alias("f2"), "v")
    return w, betas, cov, li.select("ticker", F.col("d").alias("v"))


def portfolio_risk(spark, sf):
    return _r(portfolio.portfolio_risk(*_model(spark, sf)), 9, "factor_vol", "idio_vol", "total_vol", "factor_share")


def tracking_error(spark, sf):
    w, betas, cov, idio = _model(spark, sf)
    bench = betas.groupBy("factor").agg(F.avg("b").alias("b"))
    return _r(portfolio.portfolio_risk(w, betas, cov, idio, benchmark=bench), 9, "factor_vol", "idio_vol", "total_vol", "factor_share")


def fm_factor_returns(spark, sf):
    d = _daily(spark, sf).filter("ret is not null").select("date", F.col("symbol").alias("ticker"), "ret")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), (F.col("s_acctbal") / 1000).alias("size"))
    first = prices(spark, sf).select(F.trunc("date", "month").alias("date")).distinct()
    loads = first.crossJoin(F.broadcast(s)).select("date", "ticker", (F.col("size") + F.month("date")).alias("size"))
    out = portfolio.cross_sectional_factors(d, loads, ["size"])
    return out.select("date", "n", F.round("intercept", 6).alias("market"), F.round(F.col("betas")[0], 6).alias("size"))


def _vector_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_topk(spark, sf):
    hits = retrieval.vector_search(_vector_queries(spark, sf), table(spark, sf, "embeddings"), "vec_id", "embedding", 10)
    return _r(hits, 6, "similarity")


def _text_queries(spark, sf):
    return table(spark, sf, "eval_items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def keyword_topk(spark, sf):
    return _r(retrieval.keyword_search(_text_queries(spark, sf), table(spark, sf, "documents"), "doc_id", "text", 5), 6, "score")


def _chunks(spark, sf):
    return table(spark, sf, "rag_chunks").filter("size(embedding) = 512")


def _one_in_fifty(column):
    """The stated query set: ids whose digest is divisible by 50."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("bigint") % 50 == 0


def _chunk_queries(spark, sf):
    """Every fiftieth chunk as a query: its vector, and the title of its document as the text."""
    title = table(spark, sf, "rag_documents").select(F.col("id").alias("document_id"), F.coalesce("title", F.lit("")).alias("text"))
    q = _chunks(spark, sf).filter(_one_in_fifty(F.col("id"))).select(F.col("id").alias("query_id"), "document_id", F.col("embedding").alias("vector"))
    return q.join(title, "document_id", "left").select("query_id", F.coalesce("text", F.lit("")).alias("text"), "vector")


def hybrid_search(spark, sf):
    """Vector and keyword hits over the chunks, blended."""
    hits = retrieval.retrieve(_chunk_queries(spark, sf), _chunks(spark, sf), key="id", vector="embedding", text="content", method="hybrid", k=5, weight=0.7)
    # scores have six digits already, so halves at the fifth are common; they are rounded as binary numbers, as in SQL
    return hits.select("query_id", "id", (F.round(F.col("score") * 1e5) / 1e5).alias("score"))


def _by_length(queries, texts):
    return ((queries.str.len() * 31 + texts.str.len() * 17) % 101).astype(float)


def reranked_search(spark, sf):
    """The 20 nearest chunks of each query, ordered again by a scorer of the two texts."""
    return retrieval.retrieve(_chunk_queries(spark, sf), _chunks(spark, sf), key="id", vector="embedding", text="content", method="vector", k=3, pool=20, scorer=_by_length).select("query_id", "id", "score", "rank")


def _filtered(spark, sf, asked):
    docs = retrieval.metadata_filter(table(spark, sf, "rag_documents"), doc_types=["10-K", "10-Q"], min_date="2023-06-01")
    usable = _chunks(spark, sf)
    chunks = usable.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    q = usable.filter(asked).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return _r(retrieval.block_search(q, chunks, "id", "embedding", 5, 512), 4, "similarity")


def filtered_vector_neighbours(spark, sf):
    """The 5 nearest filings chunks of every chunk in the one-in-fifty set: ids whose CRC-32 is divisible by 50."""
    return _filtered(spark, sf, F.crc32("id") % 50 == 0)


def filtered_search(spark, sf):
    """The same for the one-in-fifty set that SQL can state too."""
    return _filtered(spark, sf, _one_in_fifty(F.col("id")))


def ingest_dedup(spark, sf):
    d = table(spark, sf, "rag_documents")
    old, new = d.filter("ingested_at < timestamp'2023-09-01'"), d.filter("ingested_at >= timestamp'2023-09-01' or ingested_at is null")
    return retrieval.new_documents(new, old).select("id", "ticker", "doc_type")


def partition_scan(spark, sf):
    d = retrieval.metadata_filter(table(spark, sf, "rag_documents"), tickers=["ZVANT"], min_date="2023-06-01")
    return d.groupBy("doc_type", "filed_date").agg(F.count(F.lit(1)).alias("n"))


_QUERIES = [brinson_by_period, carino_linked, transaction_cost, tradeability_pct, attractiveness, beta_ols_single, factor_model, factor_covariance, shrunk_covariance, portfolio_risk, tracking_error, fm_factor_returns, vector_topk, keyword_topk, hybrid_search, reranked_search, filtered_vector_neighbours, filtered_search, ingest_dedup, partition_scan]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_SIDES = """j as (select year(o_orderdate) period, l_suppkey % 7 grp, o_orderpriority pr, l_extendedprice v, l_discount d from lineitem join orders on l_orderkey = o_orderkey),
pg as (select period, grp, sum(v) v, avg(d) r from j where pr = '1-URGENT' and grp <> 3 group by 1, 2), bg as (select period, grp, sum(v) v, avg(d) r from j group by 1, 2),
p as (select period, grp, v / sum(v) over (partition by period) w, r from pg), b as (select period, grp, v / sum(v) over (partition by period) w, r from bg),
u as (select coalesce(p.period, b.period) period, coalesce(p.grp, b.grp) grp, coalesce(p.w, 0) wp, coalesce(b.w, 0) wb, p.r rp0, b.r rb0 from p full join b on p.period = b.period and p.grp = b.grp),
tt as (select period, sum(wb * rb0) tb from u group by 1), e0 as (select u.*, tb, coalesce(rb0, tb) rb from u join tt using (period)), e1 as (select *, coalesce(rp0, rb) rp from e0),
e as (select period, grp, (wp - wb) * (rb - tb) allocation, wb * (rp - rb) selection, (wp - wb) * (rp - rb) interaction, wp * rp contribution, wb * rb benchmark_contribution from e1)"""
_LI3 = "x as (select l_quantity a, l_discount b, l_tax c from lineitem), n as (select count(*)::double n from x)"
_TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def oracle_sql() -> dict[str, str]:
    stop = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
    stem = r"case when length(w) > 3 then regexp_replace(regexp_replace(w, 'ies$', 'y'), '([^s])s$', '\1') else w end"
    terms = f"list_transform(list_filter({_TERMS}, lambda w: w not in ({stop})), lambda w: {stem})"
    legs = {"quality": "p_retailprice", "value": "-p_size", "momentum": "p_partkey * 31 % 101", "growth": "case when p_partkey % 4 <> 0 then p_partkey * 17 % 53 end", "stewardship": "1", "defensiveness": "length(p_name)"}
    long = " union all ".join(f"select p_brand, p_partkey, {_PILLARS[k]} w, '{k}' pillar, ({v})::double v from part" for k, v in legs.items())
    cols = {"l_quantity": "a", "l_discount": "b", "l_tax": "c"}
    cov = " union all ".join(f"select '{i}' i, '{j}' j, round(covar_samp({cols[i]}, {cols[j]}), 9) v from x" for i in cols for j in cols)
    pop = {(i, j): f"covar_pop({cols[i]}, {cols[j]})" for i in cols for j in cols}
    norm2 = " + ".join(f"({v}) ** 2" for v in pop.values())
    mu = "(" + " + ".join(pop[i, i] for i in cols) + ") / 3"
    shrunk = " union all ".join(f"select '{i}' i, '{j}' j, round((1 - rho) * (select {pop[i, j]} from x) + {'rho * mu' if i == j else '0'}, 9) v from rho" for i in cols for j in cols)
    cosine = "list_cosine_similarity(q.v::double[], e.embedding::double[])"
    model = """w0 as (select s_suppkey t, s_acctbal w from supplier where s_acctbal > 0),
l as (select l_suppkey t, avg(l_discount) b1, avg(l_tax) b2, var_pop(l_discount) d from lineitem group by 1),
w as (select l.*, w / sum(w) over () w from w0 join l using (t)), c as (select var_samp(l_discount) c11, covar_samp(l_discount, l_tax) c12, var_samp(l_tax) c22 from lineitem)"""
    risk = """r as (select x1 * x1 * c11 + 2 * x1 * x2 * c12 + x2 * x2 * c22 fv, iv from x, c)
select round(sqrt(fv * 252), 9) factor_vol, round(sqrt(iv * 252), 9) idio_vol, round(sqrt((fv + iv) * 252), 9) total_vol, round(fv / (fv + iv), 9) factor_share from r"""
    vq = "q as (select vec_id query_id, embedding v, label ql from embeddings where vec_id % 50 = 0)"
    vtop = f"select query_id, e.vec_id, {cosine} s from q, embeddings e qualify row_number() over (partition by query_id order by s desc, e.vec_id) <= 10"
    chunk_q = """with c as (select id, document_id did, content, embedding::double[512] v from rag_chunks where len(embedding) = 512),
q as (select c.id query_id, coalesce(title, '') as text, v from c left join rag_documents rd on rd.id = c.did where ('0x' || substr(md5(c.id), 1, 8))::bigint % 50 = 0),
p as (select query_id, c.id, c.did, case when array_inner_product(q.v, q.v) > 0 and array_inner_product(c.v, c.v) > 0 and isfinite(array_inner_product(q.v, q.v)) and isfinite(array_inner_product(c.v, c.v)) then round(array_inner_product(q.v, c.v) / (sqrt(array_inner_product(q.v, q.v)) * sqrt(array_inner_product(c.v, c.v))), 9) end s from q, c),
vr as (select *, row_number() over (partition by query_id order by s desc nulls last, id) r from p)"""
    ident = "concat_ws(chr(1), coalesce(ticker, chr(0)), coalesce(doc_type, chr(0)), coalesce(filed_date::varchar, chr(0)), coalesce(source, chr(0)), case when doc_type = 'news' then coalesce(external_id, chr(0)) else '' end)"
    return {
        "brinson_by_period": f"with {_SIDES} select period, grp, round(allocation, 9) allocation, round(selection, 9) selection, round(interaction, 9) interaction, round(contribution, 9) contribution, round(benchmark_contribution, 9) benchmark_contribution from e",
        "carino_linked": f"""with {_SIDES}, t as (select period, sum(contribution) rp, sum(benchmark_contribution) rb from e group by 1),
k as (select period, (ln(1 + rp) - ln(1 + rb)) / (rp - rb) k from t), c as (select exp(sum(ln(1 + rp))) - 1 cp, exp(sum(ln(1 + rb))) - 1 cb from t),
kk as (select (ln(1 + cp) - ln(1 + cb)) / (cp - cb) kk from c)
select grp, round(sum(allocation * k / kk), 9) allocation, round(sum(selection * k / kk), 9) selection, round(sum(interaction * k / kk), 9) interaction from e join k using (period), kk group by 1""",
        "transaction_cost": """with x as (select p_partkey, p_retailprice * p_size nt, case when p_size % 10 <> 0 then p_retailprice * 40 end adv, p_size / 50.0 / 0.5 sc from part),
y as (select *, greatest(3.0 + case when adv > 0 then 10 * sc * sqrt(abs(nt) / adv) else 0 end, 0) bps from x)
select p_partkey, round(bps, 7) bps, round(2 * bps, 7) round_trip_bps, round(nt * bps / 1e4, 6) cost from y""",
        "tradeability_pct": """with c as (select p_brand, p_partkey, case when p_size % 9 <> 0 then round(p_retailprice, 0) end cost from part),
r as (select p_brand, p_partkey, (rank() over (partition by p_brand order by -cost) + (count(*) over (partition by p_brand, cost) - 1) / 2.0) / count(*) over (partition by p_brand) * 100 t from c where cost is not null)
select c.*, round(t, 6) tradeability from c left join r using (p_brand, p_partkey)""",
        "attractiveness": f"""with l as ({long}), z as (select *, case when max(v) over k > min(v) over k then greatest(-3, least(3, (v - avg(v) over k) / stddev_pop(v) over k)) end z from l window k as (partition by p_brand, pillar)),
g as (select p_brand, p_partkey, sum(w * z) / sum(w) filter (where z is not null) composite, count(z) n_pillars from z group by 1, 2),
h as (select *, round(composite, 10) rc from g),
r as (select p_brand, p_partkey, (rank() over (partition by p_brand order by rc) + (count(*) over (partition by p_brand, rc) - 1) / 2.0) / count(*) over (partition by p_brand) * 100 s from h where rc is not null)
select h.p_brand, h.p_partkey, round(composite, 6) composite, round(s, 6) score, n_pillars from h left join r using (p_brand, p_partkey)""",
        "beta_ols_single": f"""with {RETURNS}, d as (select * from rets where ret is not null), m as (select date, avg(ret) market from d group by 1),
g as (select symbol, count(*) n, regr_slope(ret, market) b, regr_intercept(ret, market) a, regr_syy(ret, market) syy, regr_sxy(ret, market) sxy from d join m using (date) group by 1 having count(*) >= 3)
select symbol, n, round(a, 6) intercept, round(b, 6) beta, round((syy - b * sxy) / greatest(n - 2, 1), 6) resid_var from g""",
        "factor_model": f"""with {RETURNS}, d as (select * from rets where ret is not null), m as (select date, avg(ret) market from d group by 1),
x as (select symbol, ret y, market a, sin(dayofyear(date) / 58.0) b from d join m using (date)),
g as (select symbol, count(*) n, covar_pop(a, a) aa, covar_pop(a, b) ab, covar_pop(b, b) bb, covar_pop(a, y) ay, covar_pop(b, y) by_ from x group by 1 having count(*) >= 4)
select symbol, n, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 5) b_market, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 5) b_season from g""",
        "factor_covariance": f"with {_LI3} {cov}",
        "shrunk_covariance": f"""with {_LI3}, s as (select {norm2} norm2, {mu} mu from x), mm as (select avg(a) ma, avg(b) mb, avg(c) mc from x),
q as (select avg(((a - ma) ** 2 + (b - mb) ** 2 + (c - mc) ** 2) ** 2) q from x, mm),
rho as (select mu, case when norm2 - 3 * mu * mu > 0 then greatest(0, least((q - norm2) / n, norm2 - 3 * mu * mu) / (norm2 - 3 * mu * mu)) else 0 end rho from s, q, n) {shrunk}""",
        "portfolio_risk": f"with {model}, x as (select sum(w * b1) x1, sum(w * b2) x2, sum(w * w * d) iv from w), {risk}",
        "tracking_error": f"with {model}, m as (select avg(b1) m1, avg(b2) m2 from l), x as (select sum(w * b1) - any_value(m1) x1, sum(w * b2) - any_value(m2) x2, sum(w * w * d) iv from w, m), {risk}",
        "fm_factor_returns": f"""with {RETURNS}, f as (select distinct date_trunc('month', date)::date ld from prices),
dd as (select date, max(ld) ld from (select distinct date from rets where ret is not null) join f on ld < date group by 1),
x as (select r.date, ret y, s_acctbal / 1000 + month(ld) x from rets r join dd using (date) join supplier on s_suppkey = symbol where ret is not null)
select date, count(*) n, round(regr_intercept(y, x), 6) market, round(regr_slope(y, x), 6) size from x group by 1 having count(*) >= 6""",
        "vector_topk": f"with {vq}, t as ({vtop}) select query_id, vec_id, round(s, 6) similarity, row_number() over (partition by query_id order by s desc, vec_id) rank from t",
        "keyword_topk": f"""with q as (select item_id query_id, unnest(list_distinct({terms})) term from eval_items where item_id % 50 = 0),
d as (select doc_id, {terms} ts from documents), h as (select doc_id, len(ts) n, unnest(list_distinct(ts)) term from d),
df as (select term, ln(1 + (select count(*) from documents) / count(*)) idf from h where term in (select term from q) group by 1),
s as (select query_id, doc_id, round(sum(idf) / (1 + ln(max(n))), 9) score from h join q using (term) join df using (term) group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s)
select query_id, doc_id, round(score, 6) score, rank from r where rank <= 5""",
        "hybrid_search": f"""{chunk_q},
v as (select query_id, id, s from vr where r <= 5),
qt as (select query_id, unnest(list_distinct({terms})) term from q), kd as (select id, {terms.replace('text', 'content')} ts from c), h as (select id, len(ts) n, unnest(list_distinct(ts)) term from kd),
df as (select term, ln(1 + (select count(*) from c) / count(*)) idf from h where term in (select term from qt) group by 1),
ks as (select query_id, id, round(sum(idf) / (1 + ln(max(n))), 9) s from h join qt using (term) join df using (term) group by 1, 2), t as (select * from ks qualify row_number() over (partition by query_id order by s desc, id) <= 5),
vn as (select query_id, id, case when max(s) over w = min(s) over w then 1 else (s - min(s) over w) / (max(s) over w - min(s) over w) end x from v window w as (partition by query_id)),
tn as (select query_id, id, case when max(s) over w = min(s) over w then 1 else (s - min(s) over w) / (max(s) over w - min(s) over w) end x from t window w as (partition by query_id)),
b as (select coalesce(vn.query_id, tn.query_id) query_id, coalesce(vn.id, tn.id) id, round(0.7 * coalesce(vn.x, 0) + 0.3 * coalesce(tn.x, 0), 6) s from vn full join tn on vn.query_id = tn.query_id and vn.id = tn.id)
select query_id, id, round(s, 5) score from b qualify row_number() over (partition by query_id order by s desc, id) <= 5""",
        "reranked_search": f"""{chunk_q}, x as (select vr.query_id, vr.id, ((length(q.text) * 31 + length(c.content) * 17) % 101)::double score from vr join q using (query_id) join c on c.id = vr.id where r <= 20)
select query_id, id, score, row_number() over (partition by query_id order by score desc nulls last, id) rank from x qualify rank <= 3""",
        "filtered_search": f"""{chunk_q}, d as (select id from rag_documents where doc_type in ('10-K', '10-Q') and filed_date >= date '2023-06-01'),
f as (select query_id, id, s, row_number() over (partition by query_id order by s desc nulls last, id) rank from p where did in (select id from d))
select query_id, id, round(s, 4) similarity, rank from f where rank <= 5""",
        "ingest_dedup": f"""with k as (select *, {ident} k from rag_documents),
n as (select * from k where (ingested_at >= timestamp '2023-09-01' or ingested_at is null) and k not in (select k from k where ingested_at < timestamp '2023-09-01'))
select id, ticker, doc_type from n where id in (select min(id) from n group by k)""",
        "partition_scan": "select doc_type, filed_date, count(*) n from rag_documents where ticker = 'ZVANT' and filed_date >= date '2023-06-01' group by 1, 2",
    }
