"""DuckDB SQL for the tracking findings of the made-up stores, worked out on their
pieces."""

from __future__ import annotations

from . import cases, tracking as TR


def facts_sql() -> str:
    return f"""w AS ({cases.tag_pieces_sql()}),
 w1 AS (SELECT *, mode = 'own' AS own, home AND meta_call AND meta_id = '{cases.META}' AS call_ok, home AND meta_call AND meta_id <> '{cases.META}' AS call_bad, home AND pixel_list AND app_meta AS app_m, home AND pixel_list AND app_google AS app_g, home AND pixel_list AND custom_meta AS cust_m,
  marks + CASE WHEN pixel_list THEN 1 ELSE 0 END AS n_marks, CASE WHEN ads IS NOT NULL THEN list_filter(string_split(ads, ','), lambda x: x <> '') END AS ad_list, ads IS NOT NULL AS asked, string_split(proof_a, ':') AS pa, string_split(proof_c, ':') AS pc FROM w),
 w2 AS (SELECT *, CASE WHEN NOT home THEN 'unknown' WHEN n_marks >= 2 THEN 'confirmed' WHEN n_marks = 1 THEN 'probable' ELSE 'not_shopify' END AS ident, call_ok OR app_m OR cust_m OR container AS s_meta, (home AND ga_script) OR app_g OR container AS s_ga4, app_g AS s_ads, home AND ads_call AS s_gt, home AND gtm AS s_gtm,
  home AND klaviyo AS s_klaviyo, (CASE WHEN call_ok THEN 1 ELSE 0 END + CASE WHEN app_m THEN 1 ELSE 0 END) >= 2 OR (call_ok AND meta_again) AS twice_meta, (CASE WHEN home AND ga_script THEN 1 ELSE 0 END + CASE WHEN app_g THEN 1 ELSE 0 END + CASE WHEN container THEN 1 ELSE 0 END) >= 2 AS twice_ga,
  home AND (lang IN ('de', 'fr-ca') OR money = 'EUR') AS eu, home AND (lang = 'en-us' OR money = 'USD') AS us, home AND (lang = 'fr-ca' OR money = 'CAD') AS ca, home AND (banner OR consent > 0) AS asks, home AND consent > 0 AS defaults, contains(privacy, 'Facebook') AS names_both FROM w1),
 f AS (SELECT *, ident IN ('confirmed', 'probable') AS store, pa[1] <> '' AS given_a, CASE pa[2] WHEN 'true' THEN 'pass' WHEN 'false' THEN 'issue' ELSE 'needs_input' END AS result_a, CASE pa[1] WHEN 'said' THEN 'self_claim' ELSE 'verified' END AS badge_a,
  pc[1] <> '' AS given_c, CASE pc[2] WHEN 'true' THEN 'pass' WHEN 'false' THEN 'issue' ELSE 'needs_input' END AS result_c, CASE pc[1] WHEN 'said' THEN 'self_claim' ELSE 'verified' END AS badge_c,
  list_filter(coalesce(ad_list, []::VARCHAR[]), lambda x: CASE x WHEN 'meta' THEN NOT s_meta WHEN 'google_ads' THEN NOT (s_ads OR s_gt) ELSE true END) AS gap,
  list_filter([CASE WHEN s_ga4 AND NOT names_both THEN 'ga4' END, CASE WHEN s_ads AND NOT names_both THEN 'google_ads' END, CASE WHEN s_klaviyo THEN 'klaviyo' END, CASE WHEN s_meta AND NOT names_both THEN 'meta' END], lambda x: x IS NOT NULL) AS unnamed FROM w2)"""


def findings_sql() -> str:
    rows: list[tuple[str, str, str, str, str, str, str]] = []
    q = lambda x: f"'{x}'"
    add = lambda cid, cond, result, badge, severity, platform="'all'", note="NULL": rows.append((cid, cond, result, badge, severity, platform, note))
    add("G01", "ident = 'unknown'", q("needs_input"), q("not_found"), q("none"), note="ident")
    add("G01", "ident <> 'unknown'", q("pass"), "CASE WHEN ident = 'confirmed' THEN 'on_page' ELSE 'inferred' END", q("none"), note="CASE WHEN store THEN ident WHEN wordpress THEN 'WordPress' ELSE ident END")
    blocked = "(home AND home_result = 'blocked')"
    add("G02", "true", f"CASE WHEN {blocked} THEN 'issue' ELSE 'pass' END", f"CASE WHEN {blocked} THEN 'not_found' ELSE 'on_page' END", f"CASE WHEN {blocked} THEN 'medium' ELSE 'none' END", note=f"CASE WHEN {blocked} THEN 'homepage' END")
    flags = {"meta": "s_meta", "ga4": "s_ga4", "google_ads": "s_ads", "klaviyo": "s_klaviyo"}
    for cid, p in TR.TAG_CHECKS.items():
        seen = flags.get(p, "false")
        google = "s_gt" if p in ("ga4", "google_ads") else "false"
        badge = "CASE WHEN pc[1] = 'screenshot' THEN 'verified' WHEN app_m THEN 'on_page' ELSE 'inferred' END" if p == "meta" else q("on_page")
        high, low = ("high", "low") if cid in TR.HIGH else ("medium", "none")
        weight = f"CASE WHEN {'true' if p == 'klaviyo' else 'false'} AND asked AND uses_klaviyo THEN 'medium' WHEN NOT asked THEN '{low}' WHEN list_contains(ad_list, '{p}') THEN '{high}' ELSE 'none' END"
        add(cid, seen, q("pass"), badge, q("none"), q(p))
        add(cid, f"NOT {seen} AND {google}", q("pass"), q("inferred"), q("none"), q(p), q("google_tag"))
        add(cid, f"NOT {seen} AND NOT {google}", q("not_seen"), q("not_found"), weight, q(p))
    add("T03", "NOT s_gtm", q("not_seen"), q("not_found"), q("none"), q("gtm"))
    add("T03", "s_gtm", "CASE WHEN gtm_two THEN 'issue' ELSE 'pass' END", q("on_page"), "CASE WHEN gtm_two THEN 'low' ELSE 'none' END", q("gtm"), "CASE WHEN gtm_two THEN '2' ELSE '1' END")
    add("T09", "NOT store", q("na"), "NULL", q("none"), q("shopify"))
    add("T09", "store AND NOT pixel_list", q("not_seen"), q("not_found"), q("none"), q("shopify"))
    add("T09", "store AND pixel_list", q("pass"), "CASE WHEN given_a THEN badge_a ELSE 'on_page' END", q("none"), q("shopify"), "((CASE WHEN app_m THEN 1 ELSE 0 END) + (CASE WHEN app_g THEN 1 ELSE 0 END))::VARCHAR || '+' || CASE WHEN cust_m THEN '1' ELSE '0' END")
    add("T10", "NOT call_bad", q("pass"), q("on_page"), q("none"))
    add("T10", "call_bad", q("issue"), q("verified"), q("high"), q("meta"), "CASE WHEN meta_id = '12345' THEN 'bad_format' ELSE 'placeholder' END")
    add("T11", "NOT asked AND own", q("needs_input"), q("not_found"), q("none"))
    add("T11", "asked AND len(gap) > 0", q("issue"), q("inferred"), q("high"), note="array_to_string(list_sort(gap), ',')")
    add("T11", "asked AND len(gap) = 0", q("pass"), q("inferred"), q("none"))
    add("D01", "NOT twice_meta AND NOT twice_ga", q("pass"), q("on_page"), q("none"))
    add("D01", "twice_meta", q("issue"), q("inferred"), q("high"), q("meta"))
    add("D01", "twice_ga", q("issue"), q("inferred"), q("high"), q("ga4"))
    add("D02", "s_gtm AND gtm_two", q("issue"), q("on_page"), q("medium"), q("gtm"), q("2"))
    add("D02", "NOT (s_gtm AND gtm_two)", q("pass"), q("on_page"), q("none"))
    both = "(container AND ((home AND ga_script) OR app_g))"
    add("D03", "true", f"CASE WHEN {both} THEN 'issue' ELSE 'pass' END", f"CASE WHEN {both} THEN 'inferred' ELSE 'on_page' END", f"CASE WHEN {both} THEN 'medium' ELSE 'none' END", q("ga4"))
    old = "(home AND legacy)"
    add("D04", "true", f"CASE WHEN {old} THEN 'issue' ELSE 'pass' END", f"CASE WHEN {old} THEN 'verified' ELSE 'on_page' END", f"CASE WHEN {old} THEN 'low' ELSE 'none' END", q("ga4"))
    add("D05", "store AND own AND proof_g <> ''", q("pass"), q("self_claim"), q("none"))
    add("D05", "store AND own AND proof_g = ''", q("needs_input"), q("not_found"), q("high"))
    settled, overlap = "(own AND given_a AND result_a <> 'needs_input')", "(cust_m AND app_m)"
    add("D06", f"store AND {settled}", "result_a", "badge_a", "CASE WHEN result_a = 'issue' THEN 'high' ELSE 'none' END")
    add("D06", f"store AND NOT {settled} AND {overlap}", q("issue"), q("inferred"), q("high"))
    add("D06", f"store AND own AND NOT {settled} AND NOT {overlap}", q("needs_input"), q("not_found"), q("none"))
    ad = lambda *p: f"coalesce(list_has_any(ad_list, {list(p)}), false)"
    meta, google, tiktok = f"(s_meta OR {ad('meta')})", f"(s_ga4 OR s_ads OR s_gt OR {ad('ga4', 'google_ads', 'google_tag')})", ad("tiktok")

    def proved(cid, here, given, result, badge, weight, platform):
        add(cid, f"{here} AND own AND {given}", result, badge, f"CASE WHEN {result} = 'pass' THEN 'none' ELSE '{weight}' END", q(platform))
        add(cid, f"{here} AND NOT (own AND {given})", q("needs_input"), q("not_found"), q(weight), q(platform))

    proved("C01", meta, "given_c", "result_c", "badge_c", "high", "meta")
    proved("C01", google, "false", "'x'", "'x'", "high", "ga4")
    proved("C01", tiktok, "false", "'x'", "'x'", "high", "tiktok")
    proved("C02", f"(s_meta OR s_ga4 OR s_ads OR {ad('meta', 'ga4', 'google_ads', 'tiktok')})", "given_a", "result_a", "badge_a", "medium", "all")
    proved("S01", meta, "false", "'x'", "'x'", "high", "meta")
    proved("S02", meta, "given_c", "result_c", "badge_c", "high", "meta")
    proved("S03", tiktok, "false", "'x'", "'x'", "high", "tiktok")
    proved("S04", f"(s_ads OR s_gt OR {ad('google_ads', 'google_tag')})", "false", "'x'", "'x'", "medium", "google_ads")
    proved("S05", ad("pinterest", "snap"), "false", "'x'", "'x'", "medium", "all")
    add("P01", "NOT eu", q("na"), "NULL", q("none"))
    add("P01", "eu AND asks", q("pass"), q("inferred"), q("info"))
    add("P01", "eu AND NOT asks", q("issue"), q("not_found"), q("info"))
    add("P02", "defaults", "CASE WHEN consent = 2 THEN 'pass' ELSE 'issue' END", q("on_page"), q("info"))
    add("P02", "NOT defaults AND (s_ga4 OR s_ads OR s_gt OR s_gtm)", q("not_seen"), q("not_found"), q("info"))
    add("P02", "NOT defaults AND NOT (s_ga4 OR s_ads OR s_gt OR s_gtm)", q("na"), "NULL", q("none"))
    add("P04", "NOT us", q("na"), "NULL", q("none"))
    add("P04", "us", "CASE WHEN opt_out THEN 'pass' ELSE 'issue' END", "CASE WHEN opt_out THEN 'on_page' ELSE 'not_found' END", q("info"))
    add("P05", "NOT ca", q("na"), "NULL", q("none"))
    add("P05", "ca AND privacy = ''", q("needs_input"), q("not_found"), q("info"))
    add("P05", "ca AND privacy <> ''", "CASE WHEN contains(privacy, 'advertising') THEN 'pass' ELSE 'issue' END", q("on_page"), q("info"))
    used = "(s_meta OR s_ga4 OR s_ads OR s_klaviyo)"
    add("P06", "privacy = ''", q("not_seen"), q("not_found"), q("info"))
    add("P06", f"privacy <> '' AND NOT {used}", q("na"), "NULL", q("none"))
    add("P06", "privacy <> '' AND len(unnamed) > 0", q("issue"), q("on_page"), q("info"), note="array_to_string(unnamed, ',')")
    add("P06", f"privacy <> '' AND {used} AND len(unnamed) = 0", q("pass"), q("on_page"), q("info"))
    made = ", ".join(f"CASE WHEN {cond} THEN {{'check': '{cid}', 'platform': {platform}, 'result': {result}, 'badge': {badge}::VARCHAR, 'severity': {severity}, 'note': {note}::VARCHAR}} END" for cid, cond, result, badge, severity, platform, note in rows)
    return f"""WITH {facts_sql()}, x AS (SELECT site, unnest([{made}]) AS v FROM f),
 findings AS (SELECT site, v['check'] AS "check", v['platform'] AS platform, v['result'] AS result, v['badge'] AS badge, v['severity'] AS severity, v['note'] AS note FROM x WHERE v IS NOT NULL)"""
