"""Views that give the driver's tables the shape of the operators' inputs. One text serves Spark and DuckDB: tables stand in braces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # search performance rows
    "search_rows": """
        SELECT l.l_orderkey * 8 + l.l_linenumber AS row_seq, CAST(l.l_shipdate AS DATE) AS date, p.p_type AS query,
               concat('https://x.example/p/', CAST(l.l_suppkey AS STRING), '/') AS page,
               CAST(l.l_quantity * 10 AS DOUBLE) AS impressions, CAST(floor(l.l_quantity * l.l_discount * 2 * (1 + l.l_suppkey % 5)) AS DOUBLE) AS clicks,
               CASE WHEN l.l_orderkey % 7 = 0 THEN NULL ELSE CAST(1 + l.l_orderkey % 30 AS DOUBLE) END AS position, p.p_brand = 'Brand#2' AS branded
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    # the same with all days dealt over 40 contiguous ones, for the strict comparison
    "recent_search_rows": """
        SELECT r.row_seq, r.date, r.query, r.page, r.impressions, CAST(CASE WHEN r.date >= DATE '1998-06-21' THEN floor(r.some * 5) ELSE floor(r.some * 10) END AS DOUBLE) AS clicks, r.position, r.branded
        FROM (SELECT l.l_orderkey * 8 + l.l_linenumber AS row_seq, CAST(DATE '1998-06-01' + CAST((l.l_orderkey + l.l_linenumber) % 40 AS INTEGER) AS DATE) AS date, p.p_type AS query,
                     concat('https://x.example/p/', CAST(l.l_suppkey AS STRING), '/') AS page, CAST(l.l_quantity * 10 AS DOUBLE) AS impressions, l.l_quantity * l.l_discount AS some,
                     CASE WHEN l.l_orderkey % 7 = 0 THEN NULL ELSE CAST(1 + l.l_orderkey % 30 AS DOUBLE) END AS position, p.p_brand = 'Brand#2' AS branded
              FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey) r""",
    # paid search rows
    "ad_rows": """
        SELECT concat('ad', CAST(l.l_orderkey * 8 + l.l_linenumber AS STRING)) AS id, l.l_orderkey * 8 + l.l_linenumber AS row_seq, CAST(l.l_shipdate AS DATE) AS date,
               CASE WHEN l.l_linenumber % 3 = 0 THEN 'baidu' ELSE 'google' END AS platform,
               concat(concat('Campaign ', l.l_returnflag), concat(l.l_linestatus, CAST(l.l_orderkey % 4000 AS STRING))) AS campaign,
               concat('Group ', CAST(l.l_suppkey AS STRING)) AS ad_group, CASE WHEN l.l_linenumber % 5 = 0 THEN '' ELSE concat('term ', CAST(l.l_partkey AS STRING)) END AS search_term,
               CASE WHEN l.l_linenumber % 2 = 0 THEN 'Broad match' ELSE 'Exact match' END AS match_type,
               concat('https://x.example/p/', concat(CAST(l.l_suppkey AS STRING), '/?gclid=a&b=2&a=1')) AS landing_page,
               CAST(l.l_quantity * 10 AS DOUBLE) AS impressions, CAST(floor(l.l_quantity) AS DOUBLE) AS clicks, CAST(floor(l.l_extendedprice / 100) AS DOUBLE) AS cost,
               CAST(CASE WHEN l.l_discount > 0.07 THEN 1 ELSE 0 END AS DOUBLE) AS platform_conversions, CAST(floor(l.l_extendedprice / 50) AS DOUBLE) AS conversion_value,
               l.l_partkey % 3 = 0 AS branded, CASE WHEN l.l_linenumber = 1 THEN 'primary' WHEN l.l_linenumber = 2 THEN 'observation' ELSE 'unknown' END AS conversion_type,
               CASE WHEN l.l_suppkey % 2 = 0 THEN 'Performance Max' ELSE 'AI Max search' END AS campaign_type, CASE WHEN l.l_linenumber % 4 = 0 THEN 'oCPC' ELSE 'manual' END AS bid_strategy,
               CASE WHEN l.l_orderkey % 5 = 0 THEN concat('click', CAST(l.l_orderkey AS STRING)) ELSE '' END AS click_id,
               CASE WHEN l.l_linenumber = 1 THEN concat('Utm', CAST(l.l_orderkey % 9000 AS STRING)) ELSE '' END AS utm_campaign,
               CASE WHEN l.l_suppkey % 4 = 0 THEN 'assets' ELSE '' END AS asset_group, CASE WHEN l.l_linenumber = 3 THEN 'enabled' ELSE '' END AS final_url_expansion
        FROM {lineitem} l""",
    # business outcomes
    "business_rows": """
        SELECT concat('b', CAST(o.o_orderkey AS STRING)) AS id, o.o_orderkey AS row_seq, CAST(o.o_orderdate AS DATE) AS date,
               concat('Campaign NO', CAST(o.o_orderkey % 4000 AS STRING)) AS attribution_key, CASE WHEN o.o_orderkey % 2 = 0 THEN concat('click', CAST(o.o_orderkey AS STRING)) ELSE '' END AS click_id,
               CASE WHEN o.o_orderkey % 3 = 0 THEN concat('UTM', CAST(o.o_orderkey % 9000 AS STRING)) ELSE '' END AS utm_campaign,
               CAST(CASE WHEN o.o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS valid_conversions, CAST(floor(o.o_totalprice) AS DOUBLE) AS revenue,
               CAST(CASE WHEN o.o_orderstatus = 'F' THEN floor(o.o_totalprice / 10) ELSE 0 END AS DOUBLE) AS refunds, CAST(floor(o.o_totalprice / 5) AS DOUBLE) AS gross_profit,
               CAST(o.o_orderkey % 9 AS DOUBLE) AS conversion_delay_days
        FROM {orders} o""",
    # analytics rows
    "analytics_rows": """
        SELECT e.event_id AS row_seq, CAST(DATE '1998-03-01' + CAST(e.event_id % 60 AS INTEGER) AS DATE) AS date, concat('https://x.example/p/', concat(CAST(e.user_id % 40 AS STRING), '?a=1&b=2#top')) AS page,
               CAST(1 AS DOUBLE) AS sessions, CAST(CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE) AS key_events, CASE WHEN e.event_id % 50 = 0 THEN 'eur ' ELSE 'USD' END AS currency
        FROM {events} e""",
    # creatives
    "creative_rows": """
        SELECT p.p_partkey AS row_seq, concat('Group ', CAST(p.p_partkey % 60 AS STRING)) AS ad_group, CASE WHEN p.p_size % 10 = 0 THEN '  ' ELSE p.p_name END AS headline, p.p_type AS description,
               CASE WHEN p.p_size % 13 = 0 THEN '' ELSE concat('https://x.example/l/', CAST(p.p_partkey % 120 AS STRING)) END AS final_url
        FROM {part} p""",
    # account changes
    "change_rows": """
        SELECT c.c_custkey AS row_seq, CASE WHEN c.c_custkey % 2 = 0 THEN 'sem' ELSE 'seo' END AS channel, CASE WHEN c.c_custkey % 3 = 0 THEN 'budget' ELSE 'bid' END AS sem_dimension,
               CAST(CASE WHEN c.c_custkey % 7 = 0 THEN TIMESTAMP '1998-08-20 00:00:00' ELSE TIMESTAMP '1998-01-01 00:00:00' END AS TIMESTAMP) AS learning_until
        FROM {customer} c""",
    # web-server requests
    "log_rows": """
        SELECT e.event_id AS row_seq, concat(concat('/', e.event_type), concat('?page=', CAST(e.user_id AS STRING))) AS url, CASE WHEN e.event_id % 97 = 0 THEN 500 ELSE 200 END AS status,
               e.ts AS at, CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE CAST(floor(abs(e.value) * 10) AS DOUBLE) END AS duration_ms,
               CASE e.user_id % 5 WHEN 0 THEN 'Google' WHEN 1 THEN 'Bing' WHEN 2 THEN 'other' ELSE NULL END AS bot_family
        FROM {events} e""",
    # pages of five sites with every kind of URL and signal; robots is one text, parts between ;
    "site_pages": """
        SELECT origin, row_seq, concat(origin, path) AS url, CASE WHEN row_seq % 17 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN row_seq % 29 = 0 THEN 'timeout' ELSE NULL END AS error,
               concat('Title ', CAST(row_seq % 60 AS STRING)) AS title, CASE WHEN row_seq % 9 = 0 THEN '' ELSE concat('About ', CAST(row_seq % 110 AS STRING)) END AS description,
               concat('c', CAST(row_seq % 90 AS STRING)) AS content_fingerprint, (CAST(floor(row_seq / 40) AS BIGINT) * 2654435761) % 4294967000 + row_seq % 4 AS near_fp,
               CASE WHEN row_seq % 11 = 0 THEN 'noindex, follow' WHEN row_seq % 13 = 0 THEN 'index;nofollow' ELSE '' END AS robots,
               CASE WHEN row_seq % 3 = 0 THEN 'x' ELSE '' END AS canonical,
               CASE WHEN row_seq % 3 <> 0 THEN NULL WHEN kind = 5 THEN concat(origin, '/archive/') WHEN row_seq % 6 = 0 THEN concat(origin, path) ELSE concat(origin, '/') END AS canonical_resolved,
               CASE WHEN row_seq % 15 = 0 THEN NULL ELSE 200 END AS canonical_status, row_seq % 21 <> 0 AS canonical_indexable,
               CAST(row_seq % 400 AS BIGINT) AS text_length, row_seq % 2 = 0 AS in_sitemap, CASE WHEN row_seq % 4 = 0 THEN 'en' ELSE '' END AS language,
               CASE WHEN row_seq % 19 = 0 THEN 'attention' ELSE 'good' END AS compression_status, CASE WHEN row_seq % 7 = 0 THEN 'confirm' ELSE 'good' END AS cache_status,
               CASE WHEN row_seq % 14 = 0 THEN 'insufficient' ELSE 'private' END AS cache_reason, row_seq % 5 AS nofollow_internal, CASE WHEN row_seq % 23 = 0 THEN 2 ELSE 0 END AS blocked_resources,
               CASE WHEN row_seq % 31 = 0 THEN 1 ELSE 0 END AS schema_issues, template_key, split_part(template_key, ':', 1) AS page_type
        FROM (SELECT row_seq, origin, kind, CASE WHEN row_seq < 5 THEN '/' WHEN kind = 0 THEN concat('/blog/post-', n) WHEN kind = 1 THEN concat('/products/item-', n) WHEN kind = 2 THEN concat('/category/list-', n) WHEN kind = 3 THEN concat('/tags/t-', n)
                     WHEN kind = 4 THEN concat('/search?q=', n) WHEN kind = 5 THEN concat('/archive/page-', n) WHEN kind = 6 THEN concat('/shop?sort=', n) ELSE concat('/about-', n) END AS path,
                     CASE WHEN row_seq < 5 THEN 'other:/' WHEN kind = 0 THEN 'article:/blog/:slug' WHEN kind = 1 THEN 'product:/products/:slug' WHEN kind = 2 THEN 'category:/category/:slug' WHEN kind = 3 THEN 'tag:/tags/:slug'
                     WHEN kind = 4 THEN 'search:/search' WHEN kind = 5 THEN 'pagination:/archive/page-:n?page=:n' WHEN kind = 6 THEN 'filter:/shop?sort' ELSE 'other:/about-:n' END AS template_key
              FROM (SELECT page_id AS row_seq, concat('https://s', concat(CAST(page_id % 5 AS STRING), '.example')) AS origin, CAST(floor(page_id / 5) AS BIGINT) % 8 AS kind, CAST(page_id AS STRING) AS n FROM {pages}) a) b""",
    # links between them: each site's pages as a binary tree, with jumps back; three pages of ten have none
    "site_links": """
        SELECT a.origin, a.row_seq * 4 + k.k AS row_seq, a.url AS src, b.url AS dst
        FROM site_pages a CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) k
             JOIN site_pages b ON b.row_seq = 5 * CASE WHEN k.k < 3 THEN 2 * CAST(floor(a.row_seq / 5) AS BIGINT) + k.k ELSE CAST(floor(a.row_seq / 15) AS BIGINT) END + a.row_seq % 5
        WHERE a.row_seq < 10 OR a.row_seq % 10 < 7""",
    "site_hreflangs": """
        SELECT a.origin, a.url, 'en' AS lang, CASE WHEN a.row_seq % 24 = 0 THEN NULL WHEN a.row_seq % 8 = 0 THEN a.url ELSE b.url END AS target
        FROM site_pages a JOIN site_pages b ON a.origin = b.origin AND b.row_seq = CASE WHEN a.row_seq % 20 < 10 THEN a.row_seq + 10 ELSE a.row_seq - 10 END WHERE a.row_seq % 2 = 0""",
    "site_texts": """
        SELECT p.origin, p.url, p.row_seq, b.text FROM site_pages p CROSS JOIN (SELECT count(*) AS n FROM {benchmark}) c JOIN {benchmark} b ON b.item_id = p.row_seq % c.n""",
    "snapshot_rows": """SELECT page_id AS k, url, concat('Page title ', CAST(page_id AS STRING)) AS title FROM {pages}""",
    # findings of reports: an order is a report
    "finding_rows": """
        SELECT concat('r', CAST(l_orderkey AS STRING)) AS report_id, l_partkey AS n, concat(category, concat('.rule', CAST(l_partkey AS STRING))) AS rule_id, category, status, other, priority, CAST(l_linenumber AS DOUBLE) AS points,
               CASE status WHEN 'pass' THEN CAST(1 AS DOUBLE) WHEN 'warning' THEN CAST(0.5 AS DOUBLE) WHEN 'failure' THEN CAST(0 AS DOUBLE) ELSE NULL END AS score_ratio, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 1 END AS included,
               CASE WHEN status = 'failure' AND l_suppkey % 4 = 0 THEN 39 WHEN status = 'failure' AND l_suppkey % 4 = 1 THEN 69 ELSE NULL END AS score_cap, CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
               CASE l_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS effort, concat('cause', CAST(l_partkey % 3 AS STRING)) AS root_cause,
               CASE WHEN l_partkey % 2 = 0 THEN concat('u', CAST(l_partkey % 5 AS STRING)) ELSE concat('u1 u', CAST(l_partkey % 7 AS STRING)) END AS url_list
        FROM (SELECT *, CASE l_partkey % 6 WHEN 0 THEN 'discoverability' WHEN 1 THEN 'metadata' WHEN 2 THEN 'content' WHEN 3 THEN 'links' WHEN 4 THEN 'media' ELSE 'performance' END AS category,
                     CASE l_suppkey % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'warning' WHEN 2 THEN 'failure' WHEN 3 THEN 'informational' WHEN 4 THEN 'not_applicable' ELSE 'warning' END AS status,
                     CASE l_partkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warning' WHEN 2 THEN 'failure' ELSE 'not_applicable' END AS other,
                     concat('P', CAST(l_partkey % 4 AS STRING)) AS priority
              FROM (SELECT l_orderkey, l_partkey, min(l_suppkey) AS l_suppkey, min(l_linenumber) AS l_linenumber FROM {lineitem} GROUP BY l_orderkey, l_partkey) x) y""",
    # tracking: a user is a run
    "observation_rows": """
        SELECT concat('run', CAST(user_id AS STRING)) AS run_id, event_id AS seq, concat('o', CAST(event_id AS STRING)) AS id, CASE event_id % 4 WHEN 0 THEN 'google_analytics' WHEN 1 THEN 'google_ads' WHEN 2 THEN 'browser' ELSE 'attacker' END AS platform,
               'event' AS type, CASE WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'user_confirmed_success' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'user_confirmed_failure' WHEN event_type = 'signup' THEN 'submit_email' ELSE event_type END AS name,
               event_id * 250000 - 1000000 AS relative_ms
        FROM {events}""",
    # the same as a stream of three batches: times since the run's first event, marks, stops and lost pages among them; a tenth of the rows come a batch late
    "run_stream_rows": """
        SELECT concat('run', CAST(e.user_id AS STRING)) AS run_id, e.event_id AS seq, concat('o', CAST(e.event_id AS STRING)) AS id, CASE e.event_id % 4 WHEN 0 THEN 'google_analytics' WHEN 1 THEN 'google_ads' WHEN 2 THEN 'browser' ELSE 'attacker' END AS platform,
               CASE WHEN e.event_type IN ('error', 'purchase') AND e.event_id % 3 = 0 THEN 'route' ELSE 'event' END AS type,
               CASE WHEN e.event_type = 'error' AND e.event_id % 3 = 0 THEN 'leave' WHEN e.event_type = 'purchase' AND e.event_id % 3 = 0 THEN 'stop' WHEN e.event_type = 'click' AND e.event_id % 5 = 0 THEN 'user_confirmed_success' WHEN e.event_type = 'view' AND e.event_id % 5 = 0 THEN 'user_confirmed_failure'
                 WHEN e.event_type = 'signup' THEN 'submit_email' ELSE e.event_type END AS name,
               (e.event_id - u.first_id) * 20000 AS relative_ms,
               CASE WHEN e.event_id - u.first_id < 2000 THEN 0 WHEN e.event_id - u.first_id < 6000 THEN 1 ELSE 2 END + CASE WHEN e.event_id % 10 = 0 AND e.event_id - u.first_id < 6000 THEN 1 ELSE 0 END AS batch
        FROM {events} e JOIN (SELECT user_id, min(event_id) AS first_id FROM {events} GROUP BY user_id) u ON e.user_id = u.user_id""",
    "run_rows": """SELECT DISTINCT concat('run', CAST(user_id AS STRING)) AS run_id, 'purchase' AS goal, '' AS custom_event FROM {events}""",
    # cells as exports write them
    "cell_rows": """
        SELECT p_partkey AS row_seq, p_name AS words, CASE p_partkey % 3 WHEN 0 THEN 'Google Ads' WHEN 1 THEN 'Microsoft Advertising' ELSE 'else' END AS platform_text,
               CASE p_partkey % 6 WHEN 0 THEN concat('$1,', CAST(100 + p_size AS STRING)) WHEN 1 THEN concat(CAST(p_size AS STRING), '.5%') WHEN 2 THEN concat('(', concat(CAST(p_size AS STRING), ')')) WHEN 3 THEN 'NaN' WHEN 4 THEN '' ELSE concat(CAST(p_size AS STRING), ' d') END AS number_text,
               CASE p_partkey % 4 WHEN 0 THEN concat(concat(substr(CAST(day AS STRING), 1, 4), '/'), concat(substr(CAST(day AS STRING), 6, 2), concat('/', substr(CAST(day AS STRING), 9, 2)))) WHEN 1 THEN CAST(day AS STRING)
                 WHEN 2 THEN concat(concat(substr(CAST(day AS STRING), 1, 4), '年'), concat(substr(CAST(day AS STRING), 6, 2), concat('月', concat(substr(CAST(day AS STRING), 9, 2), '日')))) ELSE 'soon' END AS date_text, day
        FROM (SELECT p_partkey, p_name, p_size, CAST(DATE '1998-01-01' + CAST(p_partkey % 300 AS INTEGER) AS DATE) AS day FROM {part}) x""",
    # rows of exports, all cells text
    "export_rows": """
        SELECT row_seq, words, platform_text, number_text, date_text, day, CAST(row_seq % 50 AS STRING) AS clicks_text, CASE row_seq % 4 WHEN 0 THEN '' WHEN 1 THEN '12.5%' ELSE '3' END AS ctr_text,
               CASE row_seq % 5 WHEN 0 THEN '' WHEN 1 THEN '1,2' ELSE CAST(row_seq % 30 AS STRING) END AS position_text, concat(' https://x.example/p/', concat(CAST(row_seq AS STRING), ' ')) AS page_text,
               concat('Plan "', concat(CAST(row_seq % 70 AS STRING), CASE WHEN row_seq % 2 = 0 THEN '", all' ELSE concat('"', concat(chr(10), 'new')) END)) AS campaign_text,
               CASE row_seq % 6 WHEN 0 THEN 'Primary goal' WHEN 1 THEN '次要' WHEN 2 THEN 'Yes' WHEN 3 THEN '' WHEN 4 THEN 'other' ELSE 'OBSERVATION' END AS type_text
        FROM cell_rows""",
    # lines of web-server logs in the combined format, some broken; and a log table
    "log_texts": """
        SELECT row_seq, minute, second, day, kind, CASE WHEN row_seq % 23 = 0 THEN 'broken line' ELSE concat('10.0.0.1 - - [', concat(lpad(CAST(day AS STRING), 2, '0'), concat('/Mar/2024:10:', concat(lpad(CAST(minute AS STRING), 2, '0'), concat(':', concat(lpad(CAST(second AS STRING), 2, '0'),
               concat(' +0200] "GET ', concat(path, concat(' HTTP/1.1" ', concat(CAST(status AS STRING), concat(' 512 "-" "', concat(agent, concat('"', CASE WHEN row_seq % 7 = 0 THEN '' ELSE concat(' request_time=', took) END))))))))))))) END AS value,
               path, status, agent, took
        FROM (SELECT event_id AS row_seq, CAST(event_id % 60 AS INTEGER) AS minute, CAST(user_id % 60 AS INTEGER) AS second, CAST(1 + event_id % 28 AS INTEGER) AS day, CAST(user_id % 6 AS INTEGER) AS kind, CASE WHEN event_id % 97 = 0 THEN 500 ELSE 200 END AS status,
                     CASE event_id % 3 WHEN 0 THEN concat('/', concat(event_type, '?page=1#x')) WHEN 1 THEN 'https://x.example' ELSE concat('https://x.example/', event_type) END AS path, CASE event_id % 4 WHEN 0 THEN '0.25' WHEN 1 THEN '2' ELSE '1.5' END AS took,
                     CASE user_id % 6 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)' WHEN 2 THEN 'Mozilla/5.0 (compatible; Baiduspider/2.0)' WHEN 3 THEN 'Mozilla/5.0 (compatible; YandexBot/3.0)'
                       WHEN 4 THEN 'SomeCrawler/1.0' ELSE 'Mozilla/5.0 (X11; Linux)' END AS agent FROM {events}) e""",
    "page_urls": """SELECT page_id, url FROM {pages}""",
    "page_html": """SELECT page_id, url, html FROM {pages}""",
    # the same pages with more in their heads and articles, by page_id
    "captured_pages": """
        SELECT page_id, url, html AS plain, replace(replace(html, '<meta charset="utf-8">', concat('<meta charset="utf-8">', concat(
                 CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('<meta name="description" content="What page ', concat(CAST(page_id AS STRING), ' is about, in words enough for a description.">')) END, concat(
                 CASE WHEN page_id % 11 = 0 THEN '<meta name="robots" content="noindex">' ELSE '' END, concat(
                 CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('<link rel="canonical" href="', concat(replace(url, '&', '&amp;'), '">')) ELSE '<link rel="canonical" href="https://else.example/">' END, concat(
                 CASE WHEN page_id % 12 = 0 THEN '' ELSE '<meta name="viewport" content="width=device-width, initial-scale=1">' END, concat(
                 CASE page_id % 13 WHEN 0 THEN '<link rel="alternate" hreflang="xx-" href="/x">' WHEN 1 THEN '<link rel="alternate" hreflang="fr" href="/fr">' ELSE '' END,
                 CASE page_id % 7 WHEN 3 THEN concat('<script type="application/ld+json">', concat(chr(123), '</script>')) WHEN 4 THEN concat('<script type="application/ld+json">', concat(chr(123), concat('"@type": "Person", "name": "A"', concat(chr(125), '</script>')))) ELSE '' END))))))),
               '</h1>', concat('</h1>', concat(CASE page_id % 6 WHEN 0 THEN '<h3>Part</h3>' WHEN 1 THEN '<h2>Part</h2>' ELSE '' END, concat(CASE WHEN page_id % 8 = 0 THEN '<main></main>' ELSE '' END, concat(
                 CASE page_id % 4 WHEN 0 THEN '<img src="/a.png" alt="A picture" width="1" height="1">' WHEN 1 THEN '<img src="/b.png">' ELSE '' END,
                 CASE page_id % 9 WHEN 0 THEN '<a href="#nowhere">Jump</a>' WHEN 1 THEN '<a href="#">Top</a>' WHEN 2 THEN '<a href="/in" rel="nofollow"></a>' WHEN 3 THEN '<a href="#here" id="here">Here</a>' WHEN 4 THEN '<a rel="next" href="/2">Next</a>' ELSE '' END))))) AS html
        FROM {pages}""",
    # pages with what shows their stack
    "stack_rows": """
        SELECT page_id, concat(html, CASE page_id % 7 WHEN 0 THEN '<link href="/wp-content/x.css">' WHEN 1 THEN '<script src="https://cdn.shopify.com/a.js"></script>' WHEN 2 THEN '<div id="__next"></div>' WHEN 3 THEN '<script src="/_nuxt/a.js"></script><b data-v-app></b>'
               WHEN 4 THEN '<b data-reactroot></b>' ELSE '' END) AS html, CASE page_id % 4 WHEN 0 THEN 'server: nginx' WHEN 1 THEN 'Apache/2' WHEN 2 THEN 'cloudflare via nginx' ELSE NULL END AS delivery
        FROM {pages}""",
    "response_rows": """
        SELECT c_custkey AS row_seq, concat('https://x.example/a/app', CASE WHEN c_custkey % 4 = 0 THEN '-0a1b2c3d.js' ELSE '.js' END) AS url, CASE c_custkey % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/javascript' ELSE 'image/png' END AS content_type,
               CASE c_custkey % 8 WHEN 0 THEN 'no-store' WHEN 1 THEN 'private' WHEN 2 THEN 'public, max-age=31536000, immutable' WHEN 3 THEN 'max-age=600' WHEN 4 THEN 'public, max-age=90000' WHEN 5 THEN 'no-cache' WHEN 6 THEN 'max-age=0' ELSE '' END AS control,
               CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '' END AS etag, CASE c_custkey % 7 WHEN 0 THEN 'br' WHEN 1 THEN 'gzip' ELSE '' END AS encoding, 500 + c_custkey % 2000 AS size,
               CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 404 ELSE 200 END AS status
        FROM {customer}""",
    # redirects: chains, long chains and a loop
    "redirect_rows": """
        SELECT concat('u', CAST(c_custkey AS STRING)) AS src, concat('u', CAST(CASE WHEN c_custkey % 40 = 39 THEN c_custkey - 3 ELSE c_custkey + 1 END AS STRING)) AS dst FROM {customer} WHERE c_custkey % 11 <> 0""",
    "request_rows": """
        SELECT event_id AS row_seq, CASE event_id % 5 WHEN 0 THEN 'https://www.google-analytics.com/g/collect?v=2&en=page_view' WHEN 1 THEN 'https://www.googleadservices.com/pagead/conversion/1/' WHEN 2 THEN 'https://bat.bing.com/action/0?ti=1'
               WHEN 3 THEN 'https://www.clarity.ms/collect' ELSE 'https://x.example/collect' END AS url FROM {events}""",
    "document_texts": """SELECT doc_id, text FROM {documents}""",
    "conversation_rows": """SELECT conv_id, turn, role, text, turn % 2 = 0 AS is_context FROM {conversations}""",
    "sitemap_rows": """
        SELECT c.c_custkey AS row_seq, concat('/view?page=', concat(CAST(c.c_custkey AS STRING), '#x')) AS url FROM {customer} c""",
}


def _parents(sql: str) -> list[str]:
    """Other views that a view reads, in the order in which they are made."""
    return [n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN) {n}\b", sql)]


#: Views that group a large table by nearly unique keys: the table, the keys, and the other columns read. Each task's part of it is bounded, and so is its memory.
GROUPED = {"finding_rows": ("lineitem", ("l_orderkey", "l_partkey"), ("l_suppkey", "l_linenumber"))}
#: Rows of such a table for a task.
DEALT_ROWS = 500_000


def dealt(table: DataFrame, keys: tuple[str, ...], others: tuple[str, ...]) -> DataFrame:
    """A large table by its keys, in tasks as many as its rows ask for: Spark's own number of partitions doesn't grow with them. Rows are counted by the files' footers."""
    tasks = -(-table.count() // DEALT_ROWS)
    return table if tasks < 2 else table.select(*keys, *others).repartition(max(tasks, table.sparkSession.sparkContext.defaultParallelism), *keys)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(set(re.findall(r"\{(\w+)\}", sql)))}
    if name in GROUPED:
        table, keys, others = GROUPED[name]
        frames[table] = dealt(frames[table], keys, others)
    for parent in _parents(sql):
        frames[parent] = view(spark, sf_dir, parent)
        sql = re.sub(rf"\b(FROM|JOIN) {parent}\b", rf"\1 {{{parent}}}", sql)
    return spark.sql(sql, **frames)


def with_views(*names: str) -> str:
    """The WITH clause that makes views, and those that they read, for DuckDB."""
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in [*_parents(VIEWS[name]), name] if n not in ordered]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'[{](.*?)[}]', lambda m: m[1], VIEWS[n])})" for n in ordered)


def registrar(queries: dict, oracle_sql: dict):
    """The decorator of a module of queries: ``query(views, sql)`` registers f(*frames) over views, with a DuckDB twin over the same views.

    A twin starts with SELECT, or with further tables of the WITH clause. Without SQL the query has no twin.
    """

    def query(views: tuple[str, ...], sql: str | None):
        def register(f):
            queries[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
            if sql:
                more = re.match(r"\w+(\(\w+(, \w+)*\))? AS \(", sql.strip())
                oracle_sql[f.__name__] = with_views(*views) + (",\n" if more else "\n") + sql.strip()
            return f

        return register

    return query
