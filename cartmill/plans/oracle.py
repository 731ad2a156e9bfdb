"""DuckDB SQL of the queries, written on its own from their definitions."""

from __future__ import annotations

from cartmill.vocabulary import BRANDS, NON_PRODUCT, NOT_BRANDS, STOPWORDS, default_synonyms

_LATEST = """SELECT l_partkey AS product_id, l_suppkey AS shop_id, l_extendedprice / l_quantity AS price, l_linestatus = 'O' AS in_stock, l_shipdate AS observed_at
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, (l_linestatus = 'O')) AS rn FROM lineitem {where}) WHERE rn = 1"""
OFFERS = f"""offers AS (SELECT o.*, p_size * 100 AS weight_grams, CASE WHEN p_size > 0 THEN price / CAST(p_size AS DOUBLE) END AS unit_price FROM ({_LATEST.format(where='')}) o JOIN part ON p_partkey = product_id)"""
PRODUCTS = """products AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, CASE WHEN p_size <= 16 THEN 'small' WHEN p_size <= 33 THEN 'medium' ELSE 'large' END AS subcategory FROM part)"""
SHOPS = """shops AS (SELECT s_suppkey AS shop_id, lower(s_name) AS slug, s_name AS name, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
AGG = """agg AS (SELECT product_id, coalesce(min(CASE WHEN in_stock THEN price END), min(price)) AS min_price, coalesce(min(CASE WHEN in_stock THEN unit_price END), min(unit_price)) AS min_unit,
  count(DISTINCT CASE WHEN in_stock THEN shop_id END) AS shops_in_stock, count(*) AS offer_count FROM offers GROUP BY product_id)"""
RANKED = f"WITH {OFFERS}, {PRODUCTS}, {SHOPS}, {AGG}, ranked AS (SELECT product_id, name, brand, category, min_price, min_unit, shops_in_stock, offer_count FROM products JOIN agg USING (product_id)) "
FACETS = """tree AS (SELECT category, NULL AS subcategory, count(*) AS n FROM chosen GROUP BY category UNION ALL SELECT category, subcategory, count(*) FROM chosen GROUP BY category, subcategory)
SELECT category, subcategory, n, row_number() OVER (PARTITION BY subcategory IS NULL, CASE WHEN subcategory IS NOT NULL THEN category END ORDER BY lower(category) = 'other', n DESC, category, subcategory) AS place FROM tree"""
QUOTED = f"""WITH {OFFERS}, {SHOPS}, kilos AS (SELECT *, weight_grams / 1000.0 AS kg, price >= 2500.0 + 100.0 * (shop_id % 5) AS free FROM offers),
priced AS (SELECT *, CASE WHEN kg <= 1.0 THEN 12.0 WHEN kg <= 3.0 THEN 18.0 ELSE 18.0 * ceil(kg / 3.0) END AS courier, CASE WHEN kg <= 2.0 THEN 15.0 ELSE 15.0 * ceil(kg / 2.0) END AS locker FROM kilos),
quoted AS (SELECT *, CAST(CASE WHEN free THEN 0.0 ELSE least(courier, locker) END AS DOUBLE) AS cost, courier <= locker AS by_courier FROM priced) """
BASKET = f"""WITH {OFFERS}, {SHOPS}, near AS (SELECT * FROM offers WHERE in_stock), held AS (SELECT product_id, count(DISTINCT shop_id) AS n FROM near GROUP BY product_id),
few AS (SELECT product_id FROM held WHERE n >= 2 ORDER BY n, product_id LIMIT 2), four AS (SELECT product_id FROM held WHERE n >= 2 ORDER BY product_id LIMIT 4),
of_one AS (SELECT product_id FROM near WHERE shop_id = (SELECT shop_id FROM near GROUP BY shop_id ORDER BY count(*) DESC, shop_id LIMIT 1) ORDER BY product_id LIMIT 2),
unsold AS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT product_id FROM held) ORDER BY p_partkey LIMIT 1),
wanted AS (SELECT product_id, 1 + product_id % 3 AS quantity FROM (SELECT product_id FROM {{some}} UNION ALL SELECT p_partkey FROM unsold)),
found AS (SELECT n.product_id, n.shop_id, n.price, n.weight_grams, w.quantity FROM near n JOIN wanted w USING (product_id)),
k AS (SELECT count(DISTINCT product_id) AS k FROM found), bits AS (SELECT shop_id, row_number() OVER (ORDER BY shop_id) - 1 AS bit FROM (SELECT DISTINCT shop_id FROM found)) """
FEW, FOUR, OF_ONE = (BASKET.replace("{some}", x) for x in ("few", "four", "of_one"))
MASKS = "masks AS (SELECT unnest(range(1, CAST(pow(2, (SELECT count(*) FROM bits)) AS BIGINT))) AS plan), inside AS (SELECT plan, f.*, row_number() OVER (PARTITION BY plan, product_id ORDER BY price, shop_id) AS rn FROM masks JOIN bits ON (plan >> bit) & 1 = 1 JOIN found f USING (shop_id)), picks AS (SELECT * FROM inside WHERE rn = 1)"
BEST = "SELECT * FROM plans WHERE items = (SELECT k FROM k) ORDER BY cost, len(ids), bit_count(plan), ids, plan LIMIT 1"
NAIVE = "picks AS (SELECT 0 AS plan, * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, shop_id) AS rn FROM found) WHERE rn = 1)"
COST = """parcels AS (SELECT plan, shop_id, CAST(sum(CAST(price * quantity AS DECIMAL(28, 10))) AS DOUBLE) AS subtotal, sum(CASE WHEN coalesce(weight_grams, 0) = 0 THEN 500 ELSE weight_grams END * quantity) / 1000.0 AS kg, count(*) AS items, list_sort(list(product_id)) AS products FROM picks GROUP BY plan, shop_id),
fees AS (SELECT *, 2500.0 + 100.0 * (shop_id % 5) AS free_over, CASE WHEN kg <= 1.0 THEN 12.0 WHEN kg <= 3.0 THEN 18.0 ELSE 18.0 * ceil(kg / 3.0) END AS courier, CASE WHEN kg <= 2.0 THEN 15.0 ELSE 15.0 * ceil(kg / 2.0) END AS locker FROM parcels),
shipped AS (SELECT *, round(CASE WHEN subtotal >= free_over THEN 0.0 ELSE least(courier, locker) END, 2) AS shipping FROM fees),
plans AS (SELECT plan, CAST(round(sum(CAST(subtotal + shipping AS DECIMAL(28, 10))), 2) AS DOUBLE) AS cost, list_sort(list(shop_id)) AS ids, sum(items) AS items FROM shipped GROUP BY plan)"""
_MAKERS = ", ".join(f"'{x}'" for x in (*(f"brand{i}" for i in range(1, 26)), *(b for b in BRANDS if b.isalpha())))
_SAME = ", ".join(f"'{a}': '{b}'" for a, b in sorted(default_synonyms().items()))
_STOPS = ", ".join(f"'{x}'" for x in STOPWORDS)
TITLES = f"""raw AS (SELECT p_partkey AS offer_id, p_partkey % 7 AS shop_id, p_name, CASE WHEN p_partkey % 3 <> 0 THEN lower(replace(p_brand, '#', '')) END AS vendor,
  CASE WHEN p_partkey % 3 = 1 THEN '' ELSE replace(p_brand, '#', '') || ' ' END AS said, CAST(p_size AS VARCHAR) AS s FROM part),
said AS (SELECT offer_id, shop_id, vendor, CASE offer_id % 5 WHEN 0 THEN p_name || ' ' || said || s || 'kg' WHEN 1 THEN said || p_name || ' 3 x ' || s || 'kg' WHEN 2 THEN 'Ryż ' || p_name || ' – ½ ' || said || s || ' KG'
  WHEN 3 THEN p_name || ' ' || said || s || 'kg, Pack of 4' ELSE 'Premium ' || p_name || ' ' || s || '00g x 2 ' || said || 'spices' END AS title FROM raw),
cleaned AS (SELECT *, trim(regexp_replace(lower(strip_accents(replace(title, '½', '1 2'))), '[^a-z0-9.,x]+', ' ', 'g')) AS c FROM said),
sized AS (SELECT *, regexp_extract(c, '\\b([0-9]+) x ([0-9]+)(kg|g)\\b', ['n', 'v', 'u']) AS front, regexp_extract(c, '\\b([0-9]+)(kg|g) x ([0-9]+)\\b', ['v', 'u', 'n']) AS back,
  regexp_extract(c, '\\b([0-9]+) ?(kg|g)\\b', ['v', 'u']) AS one, regexp_extract(c, '\\bpack of ([0-9]+)\\b', 1) AS pack,
  string_split(trim(regexp_replace(regexp_replace(c, '\\b[0-9]+ x [0-9]+(kg|g)\\b|\\b[0-9]+(kg|g) x [0-9]+\\b', ' ', 'g'), '\\b[0-9]+ ?(kg|g)\\b', ' ', 'g')), ' ') AS ws FROM cleaned),
told AS (SELECT *, CASE WHEN front.u <> '' THEN front.u WHEN back.u <> '' THEN back.u ELSE one.u END AS unit, CASE WHEN front.u <> '' THEN front.v WHEN back.u <> '' THEN back.v ELSE one.v END AS v,
  CAST(CASE WHEN front.u <> '' THEN front.n WHEN back.u <> '' THEN back.n WHEN pack <> '' THEN pack ELSE '1' END AS INTEGER) AS multipack, coalesce(list_filter(string_split(c, ' '), lambda w: list_contains(makers, w))[1], vendor) AS brand
  FROM sized, (SELECT [{_MAKERS}] AS makers, MAP {{{_SAME}}} AS same)),
folded AS (SELECT *, list_transform(list_filter(list_transform(ws, lambda w: trim(w, '.,')), lambda w: w <> '' AND w <> coalesce(brand, '') AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_STOPS})), lambda w: coalesce(same[w], w)) AS every FROM told),
titles AS (SELECT offer_id, shop_id, brand, list_filter(every, lambda w, i: list_position(every, w) = i AND length(w) >= 2 AND w NOT IN ({_STOPS})) AS tokens,
  round(CAST(v AS INTEGER) * CASE unit WHEN 'kg' THEN 1.0 ELSE 0.001 END * multipack, 6)::DOUBLE AS base_value, multipack, printf('%g', round(CAST(v AS INTEGER) * CASE unit WHEN 'kg' THEN 1.0 ELSE 0.001 END * multipack, 6)::DOUBLE) || 'kg' AS tag FROM folded)"""
CATEGORY = "CASE WHEN list_contains(tokens, 'plate') THEN 'kitchenware' WHEN list_contains(tokens, 'spice') THEN 'spices' WHEN list_contains(tokens, 'rice') THEN 'rice' ELSE 'other' END"
IDF = """df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM titles) GROUP BY token), idf AS (SELECT token, df, ln((SELECT count(*) FROM titles WHERE len(tokens) > 0)::DOUBLE / df) AS idf FROM df)"""
KEYS = """words AS (SELECT offer_id, brand, tag, unnest(tokens) AS token FROM titles),
keys AS (SELECT offer_id, 'b:' || brand || '|' || tag AS key FROM titles WHERE len(tokens) > 0 UNION ALL SELECT offer_id, 't:' || token || '|' || tag FROM words UNION ALL SELECT offer_id, 'bt:' || brand || ':' || token || '|' || tag FROM words),
pairs AS (SELECT DISTINCT x.offer_id AS a, y.offer_id AS b FROM keys x JOIN keys y ON x.key = y.key AND x.offer_id < y.offer_id)"""
UPSERT = f"""WITH stored AS (SELECT shop_id, CAST(product_id AS VARCHAR) AS external_id, p_name AS title, price, in_stock FROM ({_LATEST.format(where="WHERE l_shipdate < TIMESTAMP '1999-01-01'")}) JOIN part ON p_partkey = product_id),
incoming AS (SELECT shop_id, CAST(product_id AS VARCHAR) AS external_id, p_name AS title, price, in_stock FROM ({_LATEST.format(where="WHERE l_shipdate >= TIMESTAMP '1999-01-01'")}) JOIN part ON p_partkey = product_id WHERE length(p_name) > 0 AND price > 0),
merged AS (SELECT coalesce(n.shop_id, o.shop_id) AS shop_id, coalesce(n.external_id, o.external_id) AS external_id, coalesce(n.title, o.title) AS title, coalesce(n.price, o.price) AS price, CASE WHEN n.shop_id IS NULL THEN false ELSE n.in_stock END AS in_stock,
  CASE WHEN o.shop_id IS NULL THEN 'created' WHEN n.shop_id IS NULL THEN CASE WHEN o.in_stock THEN 'delisted' ELSE 'gone' END WHEN abs(n.price - o.price) > 0.001 OR n.in_stock <> o.in_stock THEN 'updated' ELSE 'same' END AS status
  FROM incoming n FULL OUTER JOIN stored o ON n.shop_id = o.shop_id AND n.external_id = o.external_id) """
PATH = "CASE WHEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') END"
FOLDED = "lower(strip_accents(replace(replace(text, 'ł', 'l'), 'Ł', 'L')))"


def _words(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(set(items)))


_LEARN = f"""WITH rows AS (SELECT p_partkey % 7 AS shop_id, lower(p_type || ' ' || p_name) AS key FROM part),
w AS (SELECT shop_id, key, split_part(key, ' ', 1) AS first, split_part(key, ' ', 2) AS second FROM rows),
known AS (SELECT unnest([{_words([*NOT_BRANDS, *default_synonyms()])}]) AS t), stops AS (SELECT unnest([{_words(STOPWORDS)}]) AS t), seed AS (SELECT unnest([{_words(BRANDS)}]) AS t),
follow AS (SELECT first, second, count(*) AS n FROM w GROUP BY ALL), top AS (SELECT first, second, n, sum(n) OVER (PARTITION BY first) AS total, row_number() OVER (PARTITION BY first ORDER BY n DESC, second) AS rn FROM follow),
freq AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(string_split(key, ' '))) AS t FROM rows) GROUP BY t),
heads AS (SELECT first FROM top JOIN freq ON second = t WHERE rn = 1 AND total >= 4 AND n > 0.6 * total AND df >= 20),
one AS (SELECT first AS brand FROM w GROUP BY first HAVING (count(DISTINCT key) >= 4 OR (count(DISTINCT shop_id) >= 2 AND count(DISTINCT key) >= 2)) AND length(first) >= 3 AND regexp_full_match(first, '[a-z][a-z'' -]*')
  AND first NOT IN (SELECT t FROM known) AND first NOT IN (SELECT t FROM stops) AND first NOT IN (SELECT first FROM heads) AND first <> 'promo'),
two AS (SELECT first || ' ' || second AS brand FROM w GROUP BY first, second HAVING count(DISTINCT key) >= 4 AND second NOT IN (SELECT t FROM known) AND first NOT IN (SELECT t FROM known) AND first NOT IN (SELECT first FROM heads)
  AND first NOT IN (SELECT brand FROM one) AND first NOT IN (SELECT t FROM seed))
SELECT brand, max(source) AS source FROM (SELECT brand, 'unigram' AS source FROM one UNION ALL SELECT brand, 'bigram' FROM two UNION ALL SELECT t, 'seed' FROM seed) GROUP BY brand HAVING max(source) <> 'seed'"""

#: Twice the longest common subsequence over both lengths: one bit a letter of the first text, one step a letter of the second.
LIKENESS = """cores AS (SELECT offer_id, array_to_string(list_sort(tokens), ' ') AS core FROM titles),
letters AS (SELECT core, unnest(string_split(core, '')) AS c, unnest(range(length(core))) AS i FROM (SELECT DISTINCT core FROM cores)),
places AS (SELECT core, map(list(c), list(m)) AS marks FROM (SELECT core, c, sum(CAST(1 AS HUGEINT) << CAST(i AS HUGEINT))::HUGEINT AS m FROM letters GROUP BY core, c) GROUP BY core),
alike AS (SELECT ca, cb, 2.0 * (length(ca) - bit_count(list_reduce(list_prepend(every, list_transform(string_split(cb, ''), lambda c: coalesce(marks[c], CAST(0 AS HUGEINT)))), lambda r, h: ((r + (r & h)) | (r - (r & h))) & every))) / (length(ca) + length(cb)) AS ratio
  FROM (SELECT ca, cb, marks, ((CAST(1 AS HUGEINT) << CAST(length(ca) AS HUGEINT)) - 1)::HUGEINT AS every FROM (SELECT DISTINCT x.core AS ca, y.core AS cb FROM {pairs} JOIN cores x ON x.offer_id = a JOIN cores y ON y.offer_id = b) JOIN places ON places.core = ca)),
mass AS (SELECT offer_id, sum(idf) AS total FROM words JOIN idf USING (token) GROUP BY offer_id), common AS (SELECT a, b, sum(idf) AS c FROM {pairs} JOIN words x ON x.offer_id = a JOIN words y ON y.offer_id = b AND x.token = y.token JOIN idf ON idf.token = x.token GROUP BY a, b)"""
#: The titles at hand all have a brand and a size, so whatever shares a key and isn't rejected shares both; of the words that tell variants they have hot, red and blue.
MATCH = f"""WITH RECURSIVE {TITLES}, {IDF}, words AS (SELECT offer_id, unnest(tokens) AS token FROM titles),
listed AS (SELECT t.*, row_number() OVER (ORDER BY t.shop_id, said.title, t.offer_id) AS n FROM titles t JOIN said ON said.offer_id = t.offer_id),
near AS (SELECT o.offer_id AS a, p.offer_id AS b, o.tokens AS ta, p.tokens AS tb, p.n AS pn FROM listed o JOIN listed p ON o.brand = p.brand AND o.tag = p.tag AND p.n < o.n), {LIKENESS.replace("{pairs}", "near")},
told_apart AS (SELECT near.*, ratio, coalesce(c, 0.0) AS c, ma.total AS wa, mb.total AS wb, list_contains(ta, 'hot') <> list_contains(tb, 'hot') AS hot, list_has_any(ta, ['red', 'blue']) <> list_has_any(tb, ['red', 'blue']) AS colour,
  list_has_any(ta, ['red', 'blue']) AND list_has_any(tb, ['red', 'blue']) AND list_sort(list_intersect(ta, ['red', 'blue'])) <> list_sort(list_intersect(tb, ['red', 'blue'])) AS other
  FROM near JOIN cores x ON x.offer_id = near.a JOIN cores y ON y.offer_id = near.b JOIN alike ON ca = x.core AND cb = y.core LEFT JOIN common ON common.a = near.a AND common.b = near.b JOIN mass ma ON ma.offer_id = near.a JOIN mass mb ON mb.offer_id = near.b),
scored AS (SELECT a, b, pn, round(least(1.0, greatest(0.0, greatest(0.5 * ratio + 0.5 * c / (wa + wb - c) - 0.15 * (hot::INT + colour::INT), CASE WHEN NOT hot AND NOT colour THEN c / CASE WHEN len(ta) <= len(tb) THEN wa ELSE wb END ELSE 0.0 END) + 0.08 + 0.06)), 9) AS score FROM told_apart WHERE NOT other),
edges AS MATERIALIZED (SELECT * FROM scored WHERE score >= 0.72),
involved AS MATERIALIZED (SELECT offer_id, ways, row_number() OVER (ORDER BY n) AS k FROM listed LEFT JOIN (SELECT a, list({{'score': score, 'leader': b}} ORDER BY score DESC, pn) AS ways FROM edges GROUP BY a) ON a = offer_id WHERE offer_id IN (SELECT a FROM edges UNION SELECT b FROM edges)),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leaders, CAST(NULL AS BIGINT) AS offer_id, CAST(NULL AS BIGINT) AS joined, CAST(NULL AS DOUBLE) AS score
  UNION ALL SELECT k, CASE WHEN hit IS NULL THEN list_append(leaders, offer_id) ELSE leaders END, offer_id, hit.leader, hit.score FROM (SELECT o.k, w.leaders, o.offer_id, list_filter(ways, lambda x: list_contains(w.leaders, x.leader))[1] AS hit FROM walk w JOIN involved o ON o.k = w.k + 1)),
matched AS MATERIALIZED (SELECT listed.offer_id, coalesce(joined, listed.offer_id) AS product_offer, coalesce(round(score, 4), 1.0) AS score FROM listed LEFT JOIN walk ON walk.offer_id = listed.offer_id)"""
NAMED = """heads AS (SELECT product_offer, count(*) AS offers FROM matched GROUP BY product_offer),
named AS (SELECT row_number() OVER (ORDER BY n) AS product_id, product_offer, offers, l.brand, array_to_string(list_sort(l.tokens), ' ') AS match_core, upper(l.brand[1]) || l.brand[2:] || ' ' || array_to_string(list_transform(l.tokens, lambda t: upper(t[1]) || t[2:]), ' ') || ' ' || CASE WHEN l.multipack > 1 THEN l.multipack || 'x' ELSE '' END || v || unit AS name FROM heads JOIN listed l ON l.offer_id = product_offer JOIN told ON told.offer_id = product_offer),
slugged AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM named)"""
PAGE_TEXT = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"

SQL = {
    "q_score": f"WITH {TITLES}, {IDF}, {KEYS}, {LIKENESS.replace('{pairs}', 'pairs')} SELECT pairs.a, pairs.b, round(0.5 * ratio + 0.5 * coalesce(c, 0.0) / (ma.total + mb.total - coalesce(c, 0.0)), 6) AS name_score FROM pairs JOIN cores x ON x.offer_id = pairs.a JOIN cores y ON y.offer_id = pairs.b JOIN alike ON ca = x.core AND cb = y.core LEFT JOIN common ON common.a = pairs.a AND common.b = pairs.b JOIN mass ma ON ma.offer_id = pairs.a JOIN mass mb ON mb.offer_id = pairs.b",
    "q_match": f"{MATCH} SELECT offer_id, product_offer, score FROM matched",
    "q_products": f"{MATCH}, {NAMED} SELECT product_id, product_offer, CASE WHEN nth = 1 THEN s ELSE s || '-' || nth END AS slug, name, brand, match_core, offers FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY product_id) AS nth FROM slugged)",
    "q_html_offers": f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Item ' || page_id ELSE trim(regexp_replace(replace(replace(replace({PAGE_TEXT}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) END AS title, CASE page_id % 3 WHEN 0 THEN page_id + 0.25 WHEN 1 THEN page_id + 0.5 END::DOUBLE AS price, NOT (page_id % 3 = 0 AND page_id % 2 = 0) AS in_stock, CASE WHEN page_id % 3 = 1 THEN 'http://x/' || page_id || '.png' END AS image FROM pages",
    "q_search_price": f"{RANKED} SELECT * FROM ranked ORDER BY min_price NULLS LAST, product_id LIMIT 48",
    "q_search_unit": f"{RANKED} SELECT * FROM ranked ORDER BY min_unit NULLS LAST, product_id LIMIT 48",
    "q_search_name": f"{RANKED} SELECT * FROM ranked ORDER BY lower(name), product_id LIMIT 48",
    "q_search_offers": f"{RANKED} SELECT * FROM ranked ORDER BY shops_in_stock DESC, offer_count DESC, product_id LIMIT 48",
    "q_search_words": f"{RANKED} SELECT * FROM ranked WHERE name LIKE '%red%' AND name LIKE '%ring%'",
    "q_search_multi_shop": f"{RANKED} SELECT * FROM ranked WHERE shops_in_stock >= 2",
    "q_hidden_single_shop": f"{RANKED} SELECT count(*) FILTER (shops_in_stock < 2) AS hidden, count(*) AS total FROM agg",
    "q_search_shop": f"{RANKED} SELECT * FROM ranked WHERE product_id IN (SELECT product_id FROM offers JOIN shops USING (shop_id) WHERE slug = 'supplier#000000003')",
    "q_search_brand": f"{RANKED} SELECT * FROM ranked WHERE lower(brand) = 'brand#7'",
    "q_facets": f"WITH {OFFERS}, {PRODUCTS}, chosen AS (SELECT * FROM products WHERE product_id IN (SELECT product_id FROM offers)), {FACETS}",
    "q_facets_comparable": f"WITH {OFFERS}, {PRODUCTS}, chosen AS (SELECT * FROM products WHERE product_id IN (SELECT product_id FROM offers WHERE in_stock GROUP BY product_id HAVING count(DISTINCT shop_id) > 1)), {FACETS}",
    "q_shops": f"WITH {OFFERS}, {SHOPS} SELECT s.*, (SELECT count(*) FROM offers o WHERE o.shop_id = s.shop_id) AS offer_count FROM shops s",
    "q_stats": f"WITH {OFFERS} SELECT count(*) AS offers, count(*) FILTER (in_stock) AS in_stock, max(observed_at) AS newest, min(observed_at) AS oldest, (SELECT count(*) FROM (SELECT product_id FROM offers GROUP BY product_id HAVING count(DISTINCT shop_id) > 1)) AS comparable, (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM supplier) AS shops FROM offers",
    "q_cli_stats": f"WITH {OFFERS}, {SHOPS} SELECT name, count(*) AS n, min(price) AS cheapest FROM offers JOIN shops USING (shop_id) GROUP BY name",
    "q_product_summary": f"WITH {OFFERS}, shown AS (SELECT *, bool_or(in_stock) OVER (PARTITION BY product_id) AS live FROM offers) SELECT product_id, min(price) AS min_price, max(price) AS max_price, count(*) AS offer_count, count(DISTINCT shop_id) AS shops, min(unit_price) AS best_unit_price, CASE WHEN min(price) > 0 THEN round((max(price) - min(price)) / min(price) * 100, 1) END AS spread FROM shown WHERE in_stock OR NOT live GROUP BY product_id",
    "q_ship_quote": f"{QUOTED} SELECT product_id, shop_id, cost, CASE WHEN by_courier THEN 'courier' ELSE 'locker' END AS method, CASE WHEN by_courier THEN '2-4 d' ELSE '3-5 d' END AS eta, (CASE WHEN by_courier THEN kg > 3.0 ELSE kg > 2.0 END) OR kg > 4.0 AS over_limit, free, false AS estimated FROM quoted",
    "q_shop_prices": f"{QUOTED} SELECT product_id, shop_id, price, price + cost AS landed, in_stock FROM quoted",
    "q_product_detail": f"{QUOTED} SELECT product_id, name AS shop, price, price + cost AS landed, in_stock FROM quoted JOIN shops USING (shop_id)",
    "q_free_gap": f"WITH {OFFERS} SELECT product_id, shop_id, greatest(2500.0 + 100.0 * (shop_id % 5) - floor(price), 0.0)::DOUBLE AS gap FROM offers",
    "q_basket_weight": "SELECT l_orderkey AS order_id, CAST(sum(CASE WHEN p_size % 7 = 0 THEN 500 ELSE p_size * 100 END * CAST(l_quantity AS BIGINT)) AS BIGINT) AS grams FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "q_basket_optimal": f"{FEW}, {MASKS}, {COST} SELECT cost, array_to_string(ids, ',') AS shops FROM ({BEST})",
    "q_basket_parcels": f"{FEW}, {MASKS}, {COST} SELECT shop_id, array_to_string(products, ',') AS products, round(subtotal, 2) AS goods, shipping::DOUBLE AS shipping, round(subtotal + shipping, 2) AS total, CASE WHEN courier <= locker THEN 'courier' ELSE 'locker' END AS method, CASE WHEN courier <= locker THEN '2-4 d' ELSE '3-5 d' END AS eta, subtotal >= free_over AS free, kg > CASE WHEN courier <= locker THEN 3.0 ELSE 2.0 END OR kg > 4.0 AS over_limit, false AS estimated, greatest(round(free_over - subtotal, 2), 0.0)::DOUBLE AS to_free FROM shipped WHERE plan = (SELECT plan FROM ({BEST})) ORDER BY total DESC, shop_id",
    "q_basket_savings": f"{FEW}, {MASKS}, {COST}, one AS (SELECT min(cost) AS alone FROM plans WHERE items = (SELECT k FROM k) AND bit_count(plan) = 1), top AS ({BEST}), apart AS (SELECT cost FROM plans WHERE plan = (SELECT max(plan) FROM plans)), wait AS (SELECT max(CASE WHEN courier <= locker THEN 4 ELSE 5 END) AS max_days FROM shipped WHERE plan = (SELECT plan FROM top)) SELECT top.cost, round(apart.cost - top.cost, 2) AS saved_apart, coalesce(round(alone - top.cost, 2), 0.0) AS saved_alone, max_days, 0 AS estimated FROM top, apart, one, wait",
    "q_basket_single": f"{OF_ONE}, picks AS (SELECT shop_id AS plan, * FROM found), {COST} SELECT cost, CAST(plan AS VARCHAR) AS shops FROM plans WHERE items = (SELECT k FROM k) ORDER BY cost, plan LIMIT 1",
    "q_basket_naive": f"{FEW}, {NAIVE}, {COST} SELECT cost, array_to_string(ids, ',') AS shops FROM plans",
    "q_basket_all_naive": f"{FOUR}, {NAIVE}, {COST} SELECT cost, array_to_string(ids, ',') AS shops FROM plans",
    "q_basket_country": f"{FOUR.replace("near n JOIN", "near n JOIN shops ON shops.shop_id = n.shop_id AND country = 'NATION_3' JOIN")}, {NAIVE}, {COST} SELECT cost, array_to_string(ids, ',') AS shops FROM plans",
    "q_basket_missing": f"{FEW} SELECT product_id, quantity FROM wanted WHERE product_id NOT IN (SELECT product_id FROM found)",
    "q_price_history": "SELECT l_partkey AS product_id, lower(s_name) AS slug, l_shipdate AS observed_at, l_extendedprice / l_quantity AS price, l_linestatus = 'O' AS in_stock FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "q_history_series": "SELECT l_partkey AS product_id, l_suppkey AS shop_id, count(*) AS n_points, max(l_shipdate) AS newest, max(l_extendedprice / l_quantity) AS dearest FROM lineitem GROUP BY ALL",
    "q_price_changes": "WITH s AS (SELECT l_partkey AS product_id, l_suppkey AS shop_id, l_shipdate AS observed_at, l_extendedprice / l_quantity AS price, l_linestatus = 'O' AS in_stock, lag(l_extendedprice / l_quantity) OVER w AS p, lag(l_linestatus = 'O') OVER w AS st FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, (l_linestatus = 'O'))) SELECT product_id, shop_id, observed_at, price, in_stock FROM s WHERE p IS NULL OR abs(price - p) > 0.001 OR in_stock <> st",
    "q_upsert": f"{UPSERT} SELECT * FROM merged",
    "q_delist": f"{UPSERT} SELECT shop_id, external_id FROM merged WHERE status = 'delisted'",
    "q_ingest_counters": f"{UPSERT} SELECT count(*) FILTER (status IN ('created', 'updated', 'same')) AS fetched, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status IN ('updated', 'same')) AS updated, count(*) FILTER (status = 'updated') AS price_changes, count(*) FILTER (status = 'delisted') AS delisted FROM merged",
    "q_placeholder": "SELECT user_id AS shop_id, floor(value) AS price, count(*) AS n FROM events e WHERE floor(value) <= 2.0 GROUP BY user_id, floor(value) HAVING count(*) >= greatest(5, floor((SELECT count(*) FROM events a WHERE a.user_id = e.user_id) * 0.05))",
    "q_without_placeholder": "WITH bad AS (SELECT user_id, floor(value) AS price FROM events e WHERE floor(value) <= 2.0 GROUP BY user_id, floor(value) HAVING count(*) >= greatest(5, floor((SELECT count(*) FROM events a WHERE a.user_id = e.user_id) * 0.05))) SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.user_id = e.user_id AND bad.price = floor(e.value))",
    "q_orphans": f"WITH {OFFERS} SELECT p_partkey AS product_id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT product_id FROM offers WHERE in_stock AND price < 1000)",
    "q_clean_titles": f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({FOLDED}, '&[a-z]+;', ' ', 'g'), '[^a-z0-9.,×x\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents",
    "q_tokens": f"WITH {TITLES} SELECT offer_id, array_to_string(tokens, ' ') AS tokens, array_to_string(list_sort(tokens), ' ') AS core FROM titles",
    "q_match_key": f"WITH {TITLES} SELECT offer_id, brand || '|' || CASE WHEN len(tokens) = 0 THEN '_' ELSE array_to_string(list_sort(tokens)[1:3], '-') END || '|' || tag AS match_key FROM titles",
    "q_parse_size": f"WITH {TITLES} SELECT offer_id, base_value, 'kg' AS base_unit, multipack FROM titles",
    "q_unit_price": f"WITH {OFFERS} SELECT product_id, shop_id, unit_price FROM offers",
    "q_brand_extract": f"WITH {TITLES} SELECT offer_id, brand FROM titles",
    "q_brand_learn": _LEARN,
    "q_idf": f"WITH {TITLES}, {IDF} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "q_block_keys": f"WITH {TITLES}, {KEYS} SELECT * FROM keys",
    "q_candidates": f"WITH {TITLES}, {KEYS} SELECT * FROM pairs",
    "q_weighted_jaccard": f"WITH {TITLES}, {IDF}, {KEYS}, mass AS (SELECT offer_id, sum(idf) AS total FROM words JOIN idf USING (token) GROUP BY offer_id), common AS (SELECT a, b, sum(idf) AS c FROM pairs JOIN words x ON x.offer_id = a JOIN words y ON y.offer_id = b AND x.token = y.token JOIN idf ON idf.token = x.token GROUP BY a, b) SELECT a, b, round(coalesce(c, 0.0) / (ma.total + mb.total - coalesce(c, 0.0)), 6) AS similarity FROM pairs LEFT JOIN common USING (a, b) JOIN mass ma ON ma.offer_id = a JOIN mass mb ON mb.offer_id = b",
    "q_category": f"WITH {TITLES} SELECT offer_id, {CATEGORY} AS category, CASE {CATEGORY} WHEN 'kitchenware' THEN 'Kitchen & Home' WHEN 'spices' THEN 'Spices & Masala' WHEN 'rice' THEN 'Rice' ELSE 'Other' END AS label, CASE WHEN {CATEGORY} = 'kitchenware' THEN 'tableware' END AS subcategory FROM titles",
    "q_nonproduct": f"SELECT doc_id, NOT regexp_matches({FOLDED}, '{'|'.join(NON_PRODUCT)}') AS is_product FROM documents",
    "q_audit_category": f"WITH {TITLES} SELECT category, n, round(100 * n / (SELECT count(*) FROM titles), 2) AS percent FROM (SELECT {CATEGORY} AS category, count(*) AS n FROM titles GROUP BY 1)",
    "q_audit_tokens": f"WITH {TITLES} SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM titles WHERE {CATEGORY} = 'other') GROUP BY token ORDER BY n DESC, token LIMIT 30",
    "q_audit_price": f"WITH {OFFERS} SELECT CASE WHEN product_id % 5 = 0 THEN 'unreachable' WHEN product_id % 5 = 1 THEN CASE WHEN abs(price * 1.2 - price) < 0.011 THEN 'match' ELSE 'changed' END WHEN product_id % 5 = 2 THEN CASE WHEN abs(price * 1.5 - price) < 0.011 THEN 'match' ELSE 'check' END ELSE 'match' END AS verdict, count(*) AS n FROM offers GROUP BY 1",
    "q_url_filter": f"SELECT min(page_id) AS position, 'https://shop.example' || path AS url FROM (SELECT page_id, {PATH} AS path FROM pages) WHERE path NOT IN ('', '/') AND regexp_matches('https://shop.example' || path, '/(en|fr|de|es)/') AND NOT regexp_matches(path, '\\.html$') GROUP BY path",
    "q_external_id": f"SELECT page_id, CASE WHEN length(path) <= 110 THEN path ELSE path[1:93] || '#' || sha1(path)[1:16] END AS external_id FROM (SELECT page_id, coalesce(nullif(trim({PATH}, '/'), ''), url) AS path FROM pages)",
    "q_hrefs": "SELECT page_id, unnest(range(len(l))) AS position, unnest(l) AS url FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages)",
    "q_crawl_new": "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS url FROM pages), f AS (SELECT url, min(page_id) AS first FROM l GROUP BY url) SELECT page_id, count(DISTINCT CASE WHEN first = page_id THEN url END) AS fresh FROM l JOIN f USING (url) GROUP BY page_id",
    "q_html_extract": "SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '') AS heading FROM pages",
    "q_parse_price": "SELECT shown, price, count(*) AS n FROM (SELECT shown, nullif(TRY_CAST(replace(regexp_extract(shown, '^[0-9]+[.,][0-9]{2}'), ',', '.') AS DOUBLE), 0) AS price FROM (SELECT CAST(CAST(l_quantity AS INT) AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ',' ELSE '.' END || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || CASE WHEN l_linenumber % 3 = 0 THEN ' zł' WHEN l_linenumber % 3 = 1 THEN 'PLN' ELSE '' END AS shown FROM lineitem)) GROUP BY ALL",
    "q_lenient_float": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1.0::DOUBLE ELSE CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE) END AS number FROM events",
    "q_fx": "SELECT o_orderkey, round(floor(o_totalprice) * CASE o_orderkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 4.27::DOUBLE WHEN 2 THEN 3.95::DOUBLE ELSE 1.0::DOUBLE END, 2) AS pln FROM orders",
    "q_json_field": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k, count(*) AS n FROM events GROUP BY event_type",
    "q_variant_explode": "SELECT p_partkey || '-' || v AS external_id, CASE WHEN v = 1 THEN p_name ELSE p_name || ' Large' END AS title, 'https://shop.example/products/p' || p_partkey AS url, CAST(p_size * v AS DOUBLE) AS price, 'PLN' AS currency, true AS in_stock, CASE WHEN v = 2 THEN nullif(p_size * 100, 0) END AS weight_grams, p_brand AS brand FROM part, (SELECT unnest([1, 2]) AS v)",
    "q_store_products": "SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name || ' & more' AS title, round(p_size * 125 / 100.0::DOUBLE, 2) AS price, 'EUR' AS currency, nullif(p_size * 1000, 0) AS weight_grams FROM part",
    "q_basket_quantities": "SELECT l_partkey AS product_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY l_partkey",
    "q_status_ok": f"{UPSERT}, c AS (SELECT shop_id, count(*) FILTER (status IN ('created', 'updated', 'same')) AS fetched, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'updated') AS price_changes, count(*) FILTER (status = 'delisted') AS delisted FROM merged GROUP BY shop_id) SELECT shop_id, status FROM (SELECT *, 'ok: ' || fetched || ' fetched, ' || created || ' new, ' || price_changes || ' price changes, ' || delisted || ' delisted' AS status FROM c) WHERE status LIKE 'ok:%'",
    "q_audit_sample": f"WITH {OFFERS} SELECT shop_id, product_id AS offer_id, price FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY md5('1:' || product_id), product_id) AS rn FROM offers) WHERE rn <= 2",
    "q_inspect_titles": f"WITH {TITLES} SELECT titles.offer_id, title, brand, array_to_string(tokens, ' ') AS tokens, base_value, multipack, brand || '|' || CASE WHEN len(tokens) = 0 THEN '_' ELSE array_to_string(list_sort(tokens)[1:3], '-') END || '|' || tag AS match_key, {CATEGORY} AS category FROM titles JOIN (SELECT offer_id, title FROM said) t ON t.offer_id = titles.offer_id",
    "q_shop_status": f"{UPSERT}, c AS (SELECT shop_id, count(*) FILTER (status IN ('created', 'updated', 'same')) AS fetched, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'updated') AS price_changes, count(*) FILTER (status = 'delisted') AS delisted FROM merged GROUP BY shop_id) SELECT *, 'ok: ' || fetched || ' fetched, ' || created || ' new, ' || price_changes || ' price changes, ' || delisted || ' delisted' AS status FROM c",
    "q_reset_matches": f"WITH {OFFERS} SELECT shop_id % 5 = 0 AS match_locked, count(*) FILTER (shop_id % 5 = 0) AS matched, count(*) FILTER (shop_id % 5 = 0) AS scored, count(*) AS n FROM offers GROUP BY 1",
    "q_verify_readers": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size * 2 ELSE p_size END AS DOUBLE) AS variant, CASE WHEN p_partkey % 2 = 0 THEN 'variant' ELSE 'first variant' END AS how, CAST(p_size AS DOUBLE) AS store, p_size + 0.5::DOUBLE AS page FROM part",
}
