"""Evidence rules over observations: a registry of named column expressions.

A rule is a condition with a direction, a severity and a statement; ``evidence`` evaluates a selection of them in one projection
and gives an array of structs per record. Lexicons and lists are parameters of the builders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import holds_term, redact_email
from pagesieve.functions.urls import host, registered_domain_of_host

REGISTRY: dict[str, tuple[Callable[[], Column], str, str, str]] = {}
SEVERITIES = ("low", "medium", "high")

# Small lexicons of the evidence rules, one per matter.
LEXICONS = {
    "credential": ["password", "passwort", "contraseña", "mot de passe", "sign in", "anmelden", "se connecter", "email address"],
    "urgency": ["within 24 hours", "immediately", "locked", "suspended", "final notice", "urgent", "sofort", "dringend", "urgente"],
    "recovery": ["forgot password", "reset", "recover", "passwort vergessen", "mot de passe oublié", "olvidé"],
    "support": ["help", "contact", "support", "hilfe", "kontakt", "aide", "ayuda", "contacto", "help centre"],
    "policy": ["privacy", "terms of use", "datenschutz", "nutzungsbedingungen", "confidentialité", "conditions", "privacidad", "condiciones"],
    "cookie": ["cookies", "cookie"], "payment": ["payment", "invoice", "bank", "zahlung", "rechnung", "paiement", "facture", "pago", "factura"],
    "verification": ["verify", "confirm your", "bestätigen", "vérifier", "verificar"], "download": ["download", "attachment", "herunterladen", "télécharger", "descargar"],
    "captcha": ["captcha", "robot", "checking your browser"], "account": ["my account", "mein konto", "mon compte", "mi cuenta", "sign in"], "shop": ["shop", "cart", "checkout", "warenkorb", "panier", "carrito", "prices", "preise", "tarifs", "precios"],
}
GENERIC_TITLES = ("", "home", "index", "welcome", "loading", "app", "untitled", "login", "sign in")
ERROR_TITLES = ("404 not found", "403 forbidden", "access denied", "just a moment", "just a second", "not found", "forbidden", "error")


def rule(name: str, direction: str, severity: str, statement: str):
    def add(condition: Callable[[], Column]):
        REGISTRY[name] = (condition, direction, severity, statement)
        return condition

    return add


def prepare(observations: DataFrame, suffixes: list[str]) -> DataFrame:
    """Measures that the rules share (columns ``m_...``), from observations with id and input."""
    i = lambda c: F.col(f"input.{c}")
    none = F.array().cast("array<string>")
    forms, anchors = F.filter(i("forms.items"), lambda f: f.isNotNull()), F.filter(i("anchors.items"), lambda a: a.isNotNull())
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
    url = F.coalesce(i("final_url"), i("url"), F.lit(""))
    inputs = F.filter(F.flatten(F.transform(forms, lambda f: F.coalesce(f["inputs"], F.array().cast("array<map<string,string>>")))), lambda x: x.isNotNull())
    kind = lambda x: F.lower(F.coalesce(F.try_element_at(x, F.lit("type")), F.lit("")))
    df = observations.select(
        "id", url.alias("m_url"), F.coalesce(i("url"), F.lit("")).alias("m_start"), F.lower(F.trim(F.coalesce(i("title"), F.lit("")))).alias("m_title"), F.coalesce(i("visible_text"), F.lit("")).alias("m_text"), F.coalesce(host(url), F.lit("")).alias("m_host"),
        forms.alias("m_forms"), anchors.alias("m_anchors"), F.transform(F.filter(i("iframes.items"), lambda f: f.isNotNull()), lambda f: F.lower(F.concat_ws(" ", f["width"], f["height"], f["style"]))).alias("m_iframes"),
        size(F.filter(i("redirects"), lambda r: r.isNotNull())).alias("m_hops"), size(F.filter(inputs, lambda x: kind(x) == "password")).alias("m_passwords"), size(F.filter(inputs, lambda x: kind(x) == "hidden")).alias("m_hidden"), size(inputs).alias("m_inputs"),
        F.coalesce(i("resources.script_src_sample"), none).alias("m_scripts"), F.coalesce(i("resources.favicon_hrefs"), none).alias("m_favicons"), F.filter(i("meta"), lambda m: m.isNotNull()).alias("m_meta"),
    )
    domain = lambda c: F.coalesce(registered_domain_of_host(host(c), suffixes), F.lit(""))
    df = df.withColumns({"m_domain": F.coalesce(registered_domain_of_host(F.col("m_host"), suffixes), F.lit("")), "m_start_domain": domain(F.col("m_start")), "m_form_count": size(F.col("m_forms")), "m_anchor_count": size(F.col("m_anchors"))})
    absolute = lambda r: F.lower(F.coalesce(r, F.lit(""))).rlike("^(https?:)?//")
    outer = lambda refs: F.filter(refs, lambda r: absolute(r) & (domain(r) != F.col("m_domain")))
    actions, hrefs = F.transform("m_forms", lambda f: F.trim(F.coalesce(f["action"], F.lit("")))), F.transform("m_anchors", lambda a: F.trim(F.coalesce(a["href"], F.lit(""))))
    df = df.withColumns({"m_actions": F.coalesce(actions, none), "m_hrefs": F.coalesce(hrefs, none)})
    nulls = F.filter("m_hrefs", lambda h: h.isin("", "#") | F.lower(h).rlike("^javascript:"))
    df = df.withColumns({"m_outer_actions": F.size(outer(F.col("m_actions"))), "m_outer_anchors": F.size(outer(F.col("m_hrefs"))), "m_null_anchors": F.size(nulls), "m_outer_scripts": F.size(outer(F.col("m_scripts"))), "m_outer_icons": F.size(outer(F.col("m_favicons")))})
    df = df.withColumn("m_anchor_text", F.lower(F.concat_ws(" | ", F.transform("m_anchors", lambda a: F.coalesce(a["text"], F.lit("")))))).withColumn("m_form_text", F.lower(F.concat_ws(" | ", F.transform("m_forms", lambda f: F.coalesce(f["text"], F.lit(""))))))
    df = df.withColumn("m_low", F.lower("m_text"))
    return df.withColumn("m_credential", (F.col("m_passwords") > 0) | holds_term(F.col("m_form_text"), LEXICONS["credential"]))


def _c(name: str) -> Column:
    return F.col(f"m_{name}")


def _says(column: str, lexicon: str) -> Column:
    return holds_term(_c(column), LEXICONS[lexicon])


_labels = lambda: F.size(F.filter(F.split(_c("host"), r"\."), lambda x: x != ""))
_robots = lambda: F.exists(F.coalesce(_c("meta"), F.array().cast("array<map<string,string>>")), lambda m: (F.lower(F.coalesce(F.try_element_at(m, F.lit("name")), F.lit(""))) == "robots") & F.lower(F.coalesce(F.try_element_at(m, F.lit("content")), F.lit(""))).rlike("noindex|nofollow"))
_ratio = lambda: _c("outer_anchors") / F.greatest(F.lit(1), _c("anchor_count"))

for _name, _direction, _severity, _statement, _condition in (
    ("url.long_url", "suspicious", "low", "The address is long.", lambda: F.length(_c("url")) >= 120),
    ("url.deep_subdomain", "suspicious", "low", "The host has many labels.", lambda: (_labels() >= 4) & ~_c("host").startswith("[")),
    ("url.email_identifier", "suspicious", "medium", "The address holds an e-mail address.", lambda: redact_email(_c("url")) != _c("url")),
    ("url.homograph_or_unicode_hostname", "suspicious", "medium", "The host has letters outside ASCII.", lambda: _c("host").rlike(r"[^\x00-\x7f]|(^|\.)xn--")),
    ("url.http_not_https", "suspicious", "medium", "Credentials are asked for without encryption.", lambda: F.lower(_c("url")).startswith("http://") & _c("credential")),
    ("redirect.multi_hop", "suspicious", "low", "Several redirects lead to the page.", lambda: _c("hops") >= 2),
    ("redirect.cross_domain", "suspicious", "medium", "Redirects change the domain.", lambda: (_c("start_domain") != "") & (_c("start_domain") != _c("domain"))),
    ("redirect.https_upgrade", "benign", "low", "The page was upgraded to https.", lambda: F.lower(_c("start")).startswith("http://") & F.lower(_c("url")).startswith("https://")),
    ("meta.robots_noindex_nofollow", "suspicious", "low", "The page asks not to be indexed.", _robots),
    ("credential.password_input_present", "suspicious", "high", "A password is asked for.", lambda: _c("passwords") > 0),
    ("credential.credential_terms_near_form", "suspicious", "medium", "A form speaks of credentials.", lambda: _says("form_text", "credential")),
    ("form.presence", "neutral", "low", "The page has forms.", lambda: _c("form_count") > 0),
    ("form.empty_or_blank_action", "suspicious", "medium", "A credential form has no target.", lambda: _c("credential") & F.exists(_c("actions"), lambda a: a.isin("", "about:blank"))),
    ("form.hidden_inputs", "suspicious", "low", "A credential form has hidden fields.", lambda: _c("credential") & (_c("hidden") > 0)),
    ("form.external_action", "suspicious", "medium", "A form sends to another site.", lambda: _c("outer_actions") > 0),
    ("form.action_same_site", "benign", "low", "All forms send to the page's own site.", lambda: (_c("form_count") > 0) & (_c("outer_actions") == 0) & F.exists(_c("actions"), lambda a: a != "")),
    ("content.coercive_urgency_near_form", "suspicious", "medium", "A form comes with pressure.", lambda: (_c("form_count") > 0) & _says("low", "urgency")),
    ("content.payment_request_language", "suspicious", "low", "The text is about payments.", lambda: _says("low", "payment")),
    ("content.download_prompt", "neutral", "low", "The text offers a download.", lambda: _says("low", "download")),
    ("content.storefront", "neutral", "low", "The page is a shop.", lambda: _says("low", "shop")),
    ("verification.challenge_language", "suspicious", "low", "The text asks for a confirmation.", lambda: _says("low", "verification")),
    ("challenge.captcha_or_antibot", "uncertain", "low", "The page checks for robots.", lambda: _says("low", "captcha")),
    ("cookie.notice", "benign", "low", "The page has a consent notice.", lambda: _says("low", "cookie")),
    ("policy.privacy_terms", "benign", "low", "The page links to its policies.", lambda: _says("anchor_text", "policy")),
    ("link.recovery", "benign", "low", "The page offers account recovery.", lambda: _says("anchor_text", "recovery")),
    ("link.support_contact_legal", "benign", "low", "The page links to help.", lambda: _says("anchor_text", "support")),
    ("navigation.account_actions", "neutral", "low", "The page links to an account.", lambda: _says("anchor_text", "account")),
    ("anchors.inventory", "neutral", "low", "Links of the page.", lambda: _c("anchor_count") >= 0),
    ("link.null_or_void_anchors", "suspicious", "low", "Links lead nowhere.", lambda: _c("null_anchors") > 0),
    ("link.high_external_anchor_ratio", "suspicious", "low", "Most links of a credential page lead away.", lambda: _c("credential") & (_ratio() >= 0.8)),
    ("links.external_offsite", "neutral", "low", "Links lead to other sites.", lambda: _c("outer_anchors") > 0),
    ("navigation.functional_internal_links", "benign", "low", "Several links stay on the site.", lambda: (_c("anchor_count") - _c("outer_anchors") - _c("null_anchors")) >= 3),
    ("iframe.presence_type", "neutral", "low", "The page has frames.", lambda: F.size(_c("iframes")) > 0),
    ("iframe.hidden_iframe", "suspicious", "low", "A frame is hidden.", lambda: F.exists(_c("iframes"), lambda s: s.rlike(r"display:\s*none|visibility:\s*hidden|^0\b|\b0 0\b"))),
    ("resources.external_dependency_profile", "neutral", "low", "Scripts come from other sites.", lambda: _c("outer_scripts") > 0),
    ("brand.favicon_domain_mismatch", "suspicious", "low", "The icon comes from another site.", lambda: _c("outer_icons") > 0),
    ("login.missing_recovery_or_help_flow", "suspicious", "low", "A login without help.", lambda: _c("credential") & ~_says("low", "support") & ~_says("low", "recovery")),
    ("page.low_semantic_content", "uncertain", "medium", "The page says next to nothing.", lambda: (F.length(_c("text")) < 80) & (_c("form_count") == 0) & (_c("anchor_count") < 2)),
    ("page.rendering_incomplete_or_script_dependent", "uncertain", "medium", "The page was not rendered.", lambda: (F.length(_c("text")) < 200) & (F.size(_c("scripts")) >= 5) & (_c("form_count") == 0) & (_c("anchor_count") < 3)),
    ("capture.non_html_or_access_blocked", "uncertain", "high", "The capture is an error page.", lambda: _c("title").isin(*ERROR_TITLES)),
    ("page.generic_title", "uncertain", "low", "The title says nothing.", lambda: _c("title").isin(*GENERIC_TITLES)),
):
    rule(_name, _direction, _severity, _statement)(_condition)


def evidence(prepared: DataFrame, include: list[str] | None = None, exclude: list[str] = (), most: int | None = None) -> DataFrame:
    """(id, features): the rules that hold, each once, in the order of the registry, at most ``most`` by severity."""
    names = [n for n in (include or REGISTRY) if n not in exclude]
    fired = [F.when(F.coalesce(c(), F.lit(False)), F.struct(F.lit(n).alias("id"), F.lit(d).alias("direction"), F.lit(s).alias("severity"), F.lit(t).alias("statement"))) for n in names for c, d, s, t in [REGISTRY[n]]]
    features = F.array_distinct(F.array_compact(F.array(*fired)))
    if most:
        order = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(-i))])
        ranked = F.array_sort(F.transform(features, lambda f: F.struct(order[f["severity"]].alias("r"), f["id"].alias("id"), f.alias("f"))))
        features = F.transform(F.slice(ranked, 1, most), lambda x: x["f"])
    return prepared.select("id", features.alias("features"))


def measurements(prepared: DataFrame) -> DataFrame:
    """Numbers behind the rules."""
    return prepared.select(
        "id", F.length("m_url").alias("final_url_length"), F.length("m_start").alias("url_length"), F.col("m_host").alias("final_hostname"), _labels().alias("hostname_label_count"), F.col("m_hops").alias("redirect_count"), F.col("m_form_count").alias("form_count"), F.col("m_passwords").alias("password_input_count"),
        F.col("m_hidden").alias("hidden_input_count"), F.col("m_anchor_count").alias("anchor_count"), F.col("m_outer_anchors").alias("external_anchor_count"), F.round(_ratio(), 6).alias("external_anchor_ratio"), F.col("m_null_anchors").alias("null_anchor_count"), F.size("m_favicons").alias("favicon_count"),
        F.size("m_scripts").alias("script_src_sample_count"), F.length("m_text").alias("visible_text_length"), F.col("m_title").isin(*GENERIC_TITLES).alias("title_is_generic"),
    )
