"""A second registry of rules over prepared observations (``rules.prepare``): what pages speak of, and how they are built.

A rule is a condition, a direction (fixed, or one where a second condition holds and another where it does not) and a severity. Rules that speak of brands are
left to the caller, who has the lists (``functions.brands``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import holds_term
from pagesieve.operators.rules import ERROR_TITLES

# The words of each matter.
WORDS = {
    "login": ["login", "log in", "sign in", "signin", "authenticate", "webmail", "portal"],
    "signup": ["sign up", "signup", "register", "registration", "create account", "join now"],
    "recovery": ["forgot password", "reset password", "recover account", "password recovery", "trouble signing in"],
    "account": ["account", "my account", "account settings", "manage account", "profile", "dashboard"],
    "support": ["contact", "customer service", "faq", "help", "legal", "privacy", "support"],
    "privacy": ["cookie policy", "cookie settings", "privacy", "privacy notice", "privacy policy", "terms", "terms of service", "terms of use"],
    "cookie": ["cookie", "cookie consent", "cookie policy", "cookie settings", "accept cookies"],
    "disclosure": ["affiliate disclosure", "disclaimer", "disclosure", "risk disclosure", "sponsored"],
    "verification": ["account verification", "confirm your account", "human verification", "identity verification", "verification", "verify account", "verify identity"],
    "captcha": ["captcha", "i'm not a robot", "recaptcha", "turnstile", "verify you are human"],
    "security": ["protected by", "secure", "secure login", "security alert", "security challenge", "security notice", "ssl", "trusted"],
    "urgency": ["act now", "confirm within", "expire", "expired", "immediately", "limited time", "locked", "suspended", "unusual activity", "urgent", "verify immediately"],
    "trust": ["100% secure", "encrypted", "guaranteed", "official", "protected", "safe", "trusted", "verified"],
    "download": ["app download", "download", "download file", "download now", "download the app", "get the app"],
    "installer": ["apk", "installer", "install now", "installation", "setup file", "update your app"],
    "payment": ["bill", "invoice", "payment", "pay now", "remittance", "settlement", "transfer", "wire"],
    "checkout": ["add to cart", "billing address", "buy now", "cart", "checkout", "order summary", "shipping"],
    "lure": ["document review", "download file", "fax", "invoice", "payment", "remittance", "review document", "secure document", "shared document", "shared file", "voice mail", "voicemail"],
    "article": ["article", "breaking news", "editorial", "news", "opinion", "published", "reporter"],
    "business": ["business", "catalog", "company", "our services", "pricing", "solutions", "why choose us"],
    "profile": ["about us", "company profile", "organization", "our profile", "profile", "team"],
    "directory": ["categories", "directory", "listing", "locations", "services"],
    "chat": ["chat", "chat with us", "live chat", "message us", "support chat"],
    "comment": ["comments", "followers", "ratings", "reviews", "subscribers", "testimonials"],
}
# Providers of free mailboxes.
FREE_MAIL = ["aol.com", "gmail.com", "hotmail.com", "icloud.com", "mail.com", "outlook.com", "proton.me", "protonmail.com", "yahoo.com"]
_MAIL = r"[a-z0-9._%+-]+@([a-z0-9.-]+\.[a-z]{2,})"


def _c(name: str) -> Column:
    return F.col(f"m_{name}")


def _says(column: str, matter: str) -> Column:
    return holds_term(_c(column), WORDS[matter])


def _meta(test) -> Column:
    """Whether a meta entry meets a test of its name and content."""
    get = lambda m, k: F.lower(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("")))
    return F.exists(F.coalesce(_c("meta"), F.array().cast("array<map<string,string>>")), lambda m: test(F.concat(get(m, "name"), get(m, "property")), get(m, "content")))


def _scripts_of() -> Column:
    """Number of writing systems in the text."""
    return sum((_c("text").rlike(r).cast("int") for r in (r"\p{IsCyrillic}", r"\p{IsArabic}", r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")), _c("text").rlike(r"\p{IsLatin}").cast("int"))


def _labels() -> Column:
    return F.size(F.filter(F.split(_c("host"), r"\."), lambda x: x != ""))


def _login() -> Column:
    return (_c("passwords") > 0) | _says("form_text", "login")


def table() -> dict[str, tuple[Column, Column | str, str]]:
    """Condition, direction and severity of every rule."""
    when = lambda c, a, b: F.when(F.coalesce(c, F.lit(False)), a).otherwise(b)
    http, https, low = lambda c: F.startswith(F.lower(_c(c)), F.lit("http://")), lambda c: F.startswith(F.lower(_c(c)), F.lit("https://")), _c("low")
    inner = _c("anchor_count") - _c("outer_anchors") - _c("null_anchors")
    about = lambda matter, direction="neutral", severity="low", column="low": (_says(column, matter), direction, severity)
    return {
        "url.domain_structure": (_c("domain") != "", when(_labels() >= 4, "suspicious", "neutral"), "low"),
        "page.http_login": (http("url") & _login() & (_c("form_count") > 0), "suspicious", "high"),
        "redirect.https_upgrade": (http("start") & https("url"), "benign", "low"),
        "redirect.chain_length": (_c("hops") > 0, when(_c("hops") >= 2, "suspicious", "neutral"), "medium"),
        "redirect.destination_change": ((_c("start_domain") != "") & (_c("start_domain") != _c("domain")), "suspicious", "medium"),
        "form.presence": (F.lit(True), "neutral", "low"),
        "form.login_presence": (_login() & (_c("form_count") > 0), "neutral", "low"),
        "form.credential_collection": (_c("credential"), "suspicious", "high"),
        "form.password_cues": (_c("passwords") > 0, "suspicious", "high"),
        "form.action_external_mismatch": (_c("outer_actions") > 0, "suspicious", "low"),
        "form.action_same_site": ((_c("form_count") > 0) & (_c("outer_actions") < F.size(F.filter(_c("actions"), lambda a: a != ""))), "benign", "low"),
        "form.action_placeholder_or_self_submit": (F.exists(_c("actions"), lambda a: a.isin("", "#", "about:blank") | F.startswith(F.lower(a), F.lit("javascript:"))), "uncertain", "low"),
        "link.recovery": about("recovery", "benign", column="anchor_text"),
        "link.signup": about("signup", column="anchor_text"),
        "navigation.account_actions": about("account", column="anchor_text"),
        "contact.presence": (low.rlike(_MAIL) | F.exists(_c("hrefs"), lambda h: F.lower(h).rlike("^(mailto|tel):")), "benign", "low"),
        "contact.free_provider_email": (F.exists(F.regexp_extract_all(low, F.lit(_MAIL), F.lit(1)), lambda d: d.isin(FREE_MAIL)), "neutral", "low"),
        "link.support_contact_legal": (_says("anchor_text", "support"), when(inner >= _c("outer_anchors"), "benign", "neutral"), "low"),
        "anchors.inventory": (F.lit(True), "neutral", "low"),
        "anchors.nonfunctional": (_c("null_anchors") > 0, "suspicious", "low"),
        "navigation.internal": (inner >= 3, "benign", "low"),
        "links.external_offsite": (_c("outer_anchors") > 0, "neutral", "low"),
        "navigation.directory_store": about("directory", column="anchor_text"),
        "policy.privacy_terms": about("privacy", "benign", column="anchor_text"),
        "cookie.notice": about("cookie", "benign"),
        "disclosure.present": about("disclosure"),
        "verification.challenge_language": about("verification", "suspicious"),
        "challenge.captcha_or_antibot": about("captcha", "uncertain"),
        "security.claim_language": about("security"),
        "urgency.language": about("urgency", "suspicious"),
        "trust.reassurance_language": about("trust"),
        "language.mix_or_localization_mismatch": (_scripts_of() >= 2, "uncertain", "low"),
        "content.download_prompt": about("download"),
        "content.installer_prompt": about("installer"),
        "content.payment_request_language": about("payment", "suspicious"),
        "content.checkout_shipping_cues": about("checkout"),
        "content.transactional_lure": (_says("low", "lure"), when(_c("credential"), "suspicious", "neutral"), "low"),
        "content.article_editorial": about("article"),
        "content.business_service_catalog": about("business"),
        "content.profile_organization": about("profile"),
        "content.directory_service": about("directory"),
        "chat.widget_presence": about("chat"),
        "content.comment_social_proof": about("comment"),
        "meta.robots_noindex": (_meta(lambda n, v: (n == "robots") & v.rlike("noindex|nofollow")), "suspicious", "low"),
        "meta.cms_or_security_metadata": (_meta(lambda n, v: n.rlike("generator|csrf|verification|token")), "neutral", "low"),
        "resources.external_dependency_profile": (_c("outer_scripts") > 0, "neutral", "low"),
        "iframe.presence_type": (F.size(_c("iframes")) > 0, "neutral", "low"),
        "iframe.hidden_or_zero_sized": (F.exists(_c("iframes"), lambda s: s.rlike(r"display:\s*none|visibility:\s*hidden|^0\b|\b0 0\b")), "uncertain", "low"),
        "page.low_semantic_content": ((F.length(_c("text")) < 80) & (_c("form_count") == 0) & (_c("anchor_count") < 2), "uncertain", "low"),
        "page.access_blocked_or_error": (_c("title").isin(*ERROR_TITLES), "uncertain", "high"),
    }


def evidence(prepared: DataFrame, include: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """(id, features): the rules that hold, in the order of the table, each (id, direction, severity)."""
    rules = {k: r for k, r in table().items() if (include is None or k in include) and k not in exclude}
    text = lambda d: F.lit(d) if isinstance(d, str) else d
    fired = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("id"), text(d).alias("direction"), F.lit(s).alias("severity"))) for k, (c, d, s) in rules.items()]
    return prepared.select("id", F.array_compact(F.array(*fired)).alias("features"))
