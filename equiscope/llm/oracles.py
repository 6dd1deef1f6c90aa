"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), '" + _UP + "', '" + _LOW + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = """SELECT doc_id, max(doc_id) OVER d AS keep_id, count(*) OVER d AS group_size, doc_id = max(doc_id) OVER d AS kept, sha256(coalesce(text,'')) AS text_sha256
FROM documents WINDOW d AS (PARTITION BY coalesce(text,''))"""

OP8 = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR),'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE,1.0::DOUBLE,2.0::DOUBLE][1+(row_number() OVER (ORDER BY source NULLS LAST)-1)%3] AS w FROM s),
c AS (SELECT *, source_size*2.0::DOUBLE AS cap, source_size*2.0::DOUBLE/w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE*1.5::DOUBLE - coalesce(sum(cap) OVER b,0))/nullif(sum(w) OVER () - coalesce(sum(w) OVER b,0),0) AS level
 FROM c WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER ()*w) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget, CASE WHEN t.source_size>0 THEN CAST(floor(CAST(floor(t.target) AS BIGINT)/t.source_size) AS BIGINT) ELSE 0 END AS epochs,
 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS before
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs*size + greatest(0, least(size, budget-epochs*source_size-before)) AS BIGINT) AS taken FROM r"""

OP9 = f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, array_to_string(list_slice(w, k, k+least(13,len(w))-1),' ') AS g, least(13,len(w)) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w)-12,1)+1)) AS k FROM i WHERE len(w)>0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k+n-1),' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS k FROM d, ns WHERE len(w)>=n)),
h AS (SELECT doc_id, k, iw.n, item FROM dw JOIN iw ON iw.g=dw.g AND iw.n=dw.n),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k,k+n)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AND 20*coalesce(n_hit,0)>=len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP6 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), '""" + _UP + "', '" + _LOW + r"""'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k+least(5,len(w))-1),' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-4,1)+1)) AS k FROM d WHERE len(w)>0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g=y.g AND x.doc_id<y.doc_id GROUP BY ALL) p JOIN n na ON na.doc_id=a JOIN n nb ON nb.doc_id=b WHERE 100*i>=85*(na.n+nb.n-i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS x, a AS y FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a=r.y),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n,0) AS n_shingles, coalesce(c.m,d.doc_id) AS component_id, coalesce(c.m,d.doc_id)=d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x=d.doc_id"""

OP13 = r"""WITH d AS (SELECT doc_id, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR),'null')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8*k+1, 8) AS BIGINT) FOR k IN range(4)] AS g FROM d),
c AS (SELECT *, least(g[1]%(n+1), g[2]%(n+1)) AS a, greatest(g[1]%(n+1), g[2]%(n+1)) AS b,
 CASE WHEN t='' OR contains(t,'<P>') OR contains(t,'<S>') OR contains(t,'<M>') OR g[3]%100>=100 THEN 'plain' WHEN g[4]%100<50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a],'') AS pre, array_to_string(u[a+1:b],'') AS mid, array_to_string(u[b+1:n],'') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form<>'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form<>'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>'||pre||'<S>'||suf||'<M>'||mid ELSE '<S>'||suf||'<P>'||pre||'<M>'||mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op6_minhash_near_dedup": OP6, "op8_mixing": OP8, "op9_decontamination": OP9, "op13_fill_in_middle": OP13}
