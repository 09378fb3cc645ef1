"""Features of page markup: one pass over the tags of a page in an Arrow batch, one struct of numbers out.

A page is read once, whatever its length; nothing leaves a row but its numbers. Blank attribute values count as missing, tags
inside comments and scripts are no tags.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "title")
UNSEEN = ("script", "style", "noscript", "template", "svg")
# Kinds of inputs that take text, when the type is missing too.
TEXT_TYPES = frozenset(("", "text", "search", "url", "tel", "number"))
_WS = re.compile(r"\s+")
# Patterns of scripts, handlers and links that the features are defined by.
_JS = {
    "javascript_redirect_present": re.compile(r"(?:(?:window\s*\.\s*|document\s*\.\s*)?location(?:\s*\.\s*(?:href|replace|assign))?\s*=|(?:window\s*\.\s*)?location\s*\.\s*(?:replace|assign)\s*\()", re.I),
    "alert_or_popup_present": re.compile(r"\b(?:window\s*\.\s*)?(?:alert|open)\s*\(", re.I),
    "right_click_disabling_present": re.compile(r"contextmenu|event\.button\s*={1,2}\s*2|preventdefault\s*\(", re.I),
}
_CALLS = {
    "eval_call_count": re.compile(r"\beval\s*\(", re.I),
    "atob_call_count": re.compile(r"\batob\s*\(", re.I),
    "document_write_count": re.compile(r"\bdocument\s*\.\s*write(?:ln)?\s*\(", re.I),
    "onmouseover_handler_count": re.compile(r"\bonmouseover\b", re.I),
}
_POLICY = re.compile(r"\b(?:privacy|terms|policy|conditions)\b", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

COUNTS = (
    "length visible_text_length visible_word_count title_length current_domain_token_in_title title_registered_domain_token_present title_subdomain_token_present meta_tag_count meta_refresh_count total_tag_count unique_tag_count "
    "anchors_with_href_count anchors_missing_href_count null_or_empty_anchor_count internal_anchor_count external_anchor_count form_count credential_form_present password_form_external_action_present password_form_null_action_present "
    "null_form_action_count external_form_action_count mailto_form_action_count post_form_count input_count text_input_count password_input_count email_input_count hidden_input_count submit_button_count iframe_count external_iframe_count "
    "script_tag_count external_script_count inline_script_count stylesheet_link_count external_stylesheet_count image_count external_image_count favicon_count external_favicon_count resource_url_count unique_external_resource_domain_count "
    "hidden_element_present javascript_redirect_present eval_call_count atob_call_count document_write_count alert_or_popup_present onmouseover_handler_count right_click_disabling_present paragraph_count div_count span_count table_count "
    "list_count heading_h1_h2_h3_count footer_present navigation_present privacy_or_terms_link_present button_count option_count tr_count th_count textarea_count audio_count video_count figure_count object_count picture_count source_count h1_count h2_count h3_count link_href_count anchor_hash_count"
).split()
RATIOS = "visible_text_entropy visible_text_to_html_ratio title_url_token_overlap_ratio placeholder_link_ratio external_anchor_ratio external_to_internal_anchor_ratio hidden_input_ratio external_script_ratio external_stylesheet_ratio external_image_ratio external_resource_ratio".split()
SCHEMA = ", ".join([f"html_{c} int" for c in COUNTS] + [f"html_{c} double" for c in RATIOS])


def attributes(text: str) -> dict[str, str | None]:
    """Attributes by lower-case name; blank and bare ones are None, the first of a name counts."""
    out: dict[str, str | None] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        value = html_lib.unescape(a or b or c).strip()
        out.setdefault(name.lower(), value or None)
    return out


def read_tags(source: str) -> tuple[list[tuple[str, bool, dict]], list[tuple[str, int]]]:
    """(name, closing?, attributes) of all tags in order, and (text, number of tags before it) of the visible text."""
    tags, texts, pos, at = [], [], 0, 0
    low = source.lower()
    while True:
        m = TAG.search(source, at)
        if not m:
            break
        if m.start() > pos:
            texts.append((source[pos : m.start()], len(tags)))
        pos = at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        tags.append((name, bool(m.group(1)), {} if m.group(1) else attributes(m.group(3))))
        if not m.group(1) and name in RAW:
            end = low.find(f"</{name}", at)
            end = len(source) if end < 0 else end
            tags[-1][2]["#text"] = source[at:end]
            pos = at = end
            if name not in UNSEEN and name != "title":
                texts.append((source[m.end() : end], len(tags)))
    if pos < len(source):
        texts.append((source[pos:], len(tags)))
    return tags, texts


def registered(host: str, suffixes: frozenset[str]) -> str:
    if not host or host.startswith("[") or re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", host):
        return host
    labels = host.split(".")
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in suffixes else labels[-2:])


def host_of(url: str) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)", url, re.I)
    a = m.group(1).lower().rsplit("@", 1)[-1] if m else ""
    return a[: a.find("]") + 1] if a.startswith("[") else re.sub(r"\.*(?::\d*)?$", "", a)


def link_class(ref: str | None, base: str, domain: str, suffixes: frozenset[str]) -> str:
    """null, internal, external or '' (the page itself)."""
    if ref is None or ref.startswith("#") or ref.lower().startswith(("javascript:", "data:")) or ref.lower() == "about:blank":
        return "null"
    if ref == "/" or ref.lower().startswith(("mailto:", "tel:")):
        return ""
    try:
        host = host_of(urljoin(base, ref))
    except ValueError:
        host = ""
    return "internal" if not host or registered(host, suffixes) == domain else "external"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _tokens(s: str) -> set[str]:
    return {t for t in re.split(r"[^a-z0-9]+", s.lower()) if len(t) >= 2}


def features(source: str, title: str | None, base: str, suffixes: frozenset[str]) -> dict[str, float]:
    tags, texts = read_tags(source)
    body = next((i for i, t in enumerate(tags) if t[0] == "body" and not t[1]), -1)
    text = _WS.sub(" ", html_lib.unescape(" ".join(t for t, k in texts if k > body))).strip()
    opened = [t for t in tags if not t[1]]
    count = Counter(t[0] for t in opened)
    host = host_of(base)
    domain = registered(host, suffixes)
    own = next((t[2]["#text"] for t in opened if t[0] == "title"), "")
    title = _WS.sub(" ", (title or "").strip() or html_lib.unescape(own)).strip()[:300]
    of = lambda *names: [t[2] for t in opened if t[0] in names]
    kind = lambda ref: link_class(ref, base, domain, suffixes)

    anchors = of("a")
    kinds = [kind(a.get("href")) for a in anchors]
    missing = sum(a.get("href") is None for a in anchors)
    nulls, inner, outer = kinds.count("null"), kinds.count("internal"), kinds.count("external")
    # forms and what stands in them
    forms, form = [], None
    for name, closing, a in tags:
        if name == "form":
            form = None if closing else {"action": a.get("action"), "method": (a.get("method") or "").lower(), "password": False, "submit": False}
            if form:
                forms.append(form)
        elif form and not closing and name in ("input", "button"):
            t = (a.get("type") or "").lower()
            form["password"] |= name == "input" and _is_password(a)
            form["submit"] |= t == "submit" or name == "button" and t == "" or name == "input" and t == "image"
    actions = [("mailto" if (f["action"] or "").lower().startswith("mailto:") else kind(f["action"])) for f in forms]
    inputs, buttons = of("input"), of("button")
    types = [(i.get("type") or "").lower() for i in inputs]
    # resources by kind
    rel = lambda a, word: word in (a.get("rel") or "") and a.get("href") is not None
    groups = {
        "script": [a["src"] for a in of("script") if a.get("src")], "stylesheet": [a["href"] for a in of("link") if rel(a, "stylesheet")], "image": [a["src"] for a in of("img") if a.get("src")],
        "favicon": [a["href"] for a in of("link") if rel(a, "icon")], "iframe": [a["src"] for a in of("iframe") if a.get("src")], "media": [a["src"] for a in of("source", "video", "audio", "embed") if a.get("src")],
    }
    classes = {g: [kind(r) for r in refs] for g, refs in groups.items()}
    ext = {g: c.count("external") for g, c in classes.items()}
    inn = {g: c.count("internal") for g, c in classes.items()}
    total = sum(map(len, groups.values()))
    outside = {registered(host_of(urljoin(base, r)), suffixes) for g, refs in groups.items() for r, k in zip(refs, classes[g]) if k == "external"}
    share = lambda a, b: round(a / max(1, b), 6)
    token = domain.split(".")[0]
    titled, urled = _tokens(title), _tokens(base)
    sub = host[: -len(domain) - 1] if domain and host.endswith("." + domain) else ""
    hidden = any(("hidden" in a and a["hidden"] is not None) or _HIDDEN.search(a.get("style") or "") or (a.get("aria-hidden") or "") == "true" for _, _, a in opened)
    linked = _anchor_texts(tags, texts)
    out = {
        "length": len(source), "visible_text_length": len(text), "visible_word_count": len(text.split(" ")) if text else 0, "visible_text_entropy": round(entropy(text), 6), "visible_text_to_html_ratio": share(len(text), len(source)),
        "title_length": len(title), "current_domain_token_in_title": int(len(token) >= 3 and token in re.sub(r"[^a-z0-9]", "", title.lower())), "title_url_token_overlap_ratio": share(len(titled & urled), len(titled)),
        "title_registered_domain_token_present": int(token in titled), "title_subdomain_token_present": int(bool(titled & _tokens(sub))), "meta_tag_count": count["meta"],
        "meta_refresh_count": sum((a.get("http-equiv") or "").lower() == "refresh" for a in of("meta")), "total_tag_count": len(opened), "unique_tag_count": len(count), "anchors_with_href_count": len(anchors) - missing, "anchors_missing_href_count": missing,
        "null_or_empty_anchor_count": nulls, "placeholder_link_ratio": share(nulls, len(anchors)), "internal_anchor_count": inner, "external_anchor_count": outer, "external_anchor_ratio": share(outer, len(anchors) - missing),
        "external_to_internal_anchor_ratio": share(outer, inner), "form_count": len(forms), "credential_form_present": int(any(f["password"] and f["submit"] for f in forms)),
        "password_form_external_action_present": int(any(f["password"] and k == "external" for f, k in zip(forms, actions))), "password_form_null_action_present": int(any(f["password"] and k == "null" for f, k in zip(forms, actions))),
        "null_form_action_count": actions.count("null"), "external_form_action_count": actions.count("external"), "mailto_form_action_count": actions.count("mailto"), "post_form_count": sum(f["method"] == "post" for f in forms),
        "input_count": len(inputs), "text_input_count": sum(t in TEXT_TYPES for t in types), "password_input_count": sum(map(_is_password, inputs)), "email_input_count": sum(map(_is_email, inputs)), "hidden_input_count": types.count("hidden"),
        "hidden_input_ratio": share(types.count("hidden"), len(inputs)), "submit_button_count": sum((b.get("type") or "").lower() in ("", "submit") for b in buttons) + types.count("submit"), "iframe_count": count["iframe"], "external_iframe_count": ext["iframe"],
        "script_tag_count": count["script"], "external_script_count": ext["script"], "external_script_ratio": share(ext["script"], ext["script"] + inn["script"]), "inline_script_count": count["script"] - len(groups["script"]),
        "stylesheet_link_count": len(groups["stylesheet"]), "external_stylesheet_count": ext["stylesheet"], "external_stylesheet_ratio": share(ext["stylesheet"], ext["stylesheet"] + inn["stylesheet"]), "image_count": count["img"], "external_image_count": ext["image"],
        "external_image_ratio": share(ext["image"], ext["image"] + inn["image"]), "favicon_count": len(groups["favicon"]), "external_favicon_count": ext["favicon"], "resource_url_count": total, "unique_external_resource_domain_count": len(outside),
        "external_resource_ratio": share(sum(ext.values()), total), "hidden_element_present": int(hidden), "paragraph_count": count["p"], "div_count": count["div"], "span_count": count["span"], "table_count": count["table"], "list_count": count["ul"] + count["ol"] + count["dl"],
        "heading_h1_h2_h3_count": count["h1"] + count["h2"] + count["h3"], "footer_present": int(count["footer"] > 0), "navigation_present": int(count["nav"] > 0), "privacy_or_terms_link_present": int(any(_POLICY.search(t + " " + (a.get("href") or "")) for t, a in linked)),
        "button_count": count["button"], "option_count": count["option"], "tr_count": count["tr"], "th_count": count["th"], "textarea_count": count["textarea"], "audio_count": count["audio"], "video_count": count["video"], "figure_count": count["figure"], "object_count": count["object"],
        "picture_count": count["picture"], "source_count": count["source"], "h1_count": count["h1"], "h2_count": count["h2"], "h3_count": count["h3"], "link_href_count": sum(a.get("href") is not None for a in of("link")), "anchor_hash_count": sum((a.get("href") or "").startswith("#") for a in anchors),
    }
    return out | {k: int(bool(p.search(source))) for k, p in _JS.items()} | {k: len(p.findall(source)) for k, p in _CALLS.items()}


def _about(a: dict) -> str:
    return " ".join(a.get(k) or "" for k in ("name", "id", "placeholder", "autocomplete", "aria-label"))


def _is_password(a: dict) -> bool:
    return (a.get("type") or "").lower() == "password" or bool(re.search(r"\bpass(?:word)?\b", _about(a), re.I))


def _is_email(a: dict) -> bool:
    return (a.get("type") or "").lower() == "email" or bool(re.search(r"\bemail\b", _about(a), re.I))


def _anchor_texts(tags: list, texts: list) -> list[tuple[str, dict]]:
    out, by = [], {}
    for t, k in texts:
        by[k] = by.get(k, "") + t
    for i, (name, closing, a) in enumerate(tags):
        if name == "a" and not closing:
            j, s = i + 1, by.get(i + 1, "")
            while j < len(tags) and not (tags[j][0] == "a"):
                j += 1
                s += by.get(j, "")
            out.append((html_lib.unescape(s), a))
    return out


def html_features(df: DataFrame, ident: str, html: str, title: str, base: str, suffixes: list[str]) -> DataFrame:
    """(ident, html_...) of every row; null html counts as ''."""
    listed, types = frozenset(suffixes), dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                rows = [features(h or "", t, u or "", listed) for h, t, u in zip(part.column("_h").to_pylist(), part.column("_t").to_pylist(), part.column("_u").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(ident), *[pa.array([r[c] for r in rows], pa.int32()) for c in COUNTS], *[pa.array([float(r[c]) for r in rows], pa.float64()) for c in RATIOS]], names=[ident, *[f"html_{c}" for c in (*COUNTS, *RATIOS)]])

    picked = df.select(ident, F.col(html).alias("_h"), F.col(title).alias("_t"), F.col(base).alias("_u"))
    return picked.mapInArrow(run, f"`{ident}` {types[ident]}, {SCHEMA}")


#: The classical feature set, from the columns above.
CLASSICAL = {
    "has_title": "html_title_length > 0", "has_input": "html_input_count > 0", "has_text_input": "html_text_input_count > 0", "has_submit": "html_submit_button_count > 0", "number_of_internal_links": "html_internal_anchor_count", "number_of_external_links": "html_external_anchor_count",
    "has_password": "html_password_input_count > 0", "has_email_input": "html_email_input_count > 0", "has_hidden_element": "html_hidden_element_present > 0", "has_audio": "html_audio_count > 0", "has_video": "html_video_count > 0", "number_of_inputs": "html_input_count",
    "number_of_buttons": "html_button_count", "number_of_images": "html_image_count", "has_image": "html_image_count > 0", "number_of_options": "html_option_count", "number_of_lists": "html_list_count", "number_of_th": "html_th_count", "number_of_tr": "html_tr_count",
    "number_of_tables": "html_table_count", "number_of_href": "html_anchors_with_href_count + html_link_href_count", "number_of_paragraphs": "html_paragraph_count", "number_of_scripts": "html_script_tag_count", "number_of_clickable_buttons": "html_button_count", "number_of_tags": "html_total_tag_count",
    "number_of_divs": "html_div_count", "number_of_figures": "html_figure_count", "has_footer": "html_footer_present > 0", "has_form": "html_form_count > 0", "has_text_area": "html_textarea_count > 0", "has_iframe": "html_iframe_count > 0", "number_of_meta": "html_meta_tag_count",
    "has_navigation": "html_navigation_present > 0", "has_object": "html_object_count > 0", "has_picture": "html_picture_count > 0", "number_of_sources": "html_source_count", "number_of_spans": "html_span_count", "length_of_text": "html_visible_text_length", "length_of_title": "html_title_length",
    "has_h1": "html_h1_count > 0", "has_h2": "html_h2_count > 0", "has_h3": "html_h3_count > 0", "has_alert_window": "html_alert_or_popup_present > 0", "has_redirection": "html_javascript_redirect_present + html_meta_refresh_count > 0",
    "consistency_between_title_and_url_brand": "html_title_registered_domain_token_present + html_title_subdomain_token_present > 0",
}


def classical_features(features_df: DataFrame, ident: str) -> DataFrame:
    return features_df.select(ident, *[F.expr(f"cast({e} as int)").alias(k) for k, e in CLASSICAL.items()])
