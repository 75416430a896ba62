"""Labelled pages the extraction model learns from, besides those of the table.

Pages are put together from parts: a shell for the main text, blocks inside it, and parts that do not belong to it
before, inside and after. `data-main` opens main text and `data-off` what is none; nodes inherit the nearest mark above.
The same seed gives the same pages everywhere.
"""

from __future__ import annotations

import random

WORDS = "the river rose in night and bridge was closed by noon; people from valley came to help, as they had done before. water fell again after three days".split()

SHELLS = (
    "<article {}>|</article>",
    "<main {}>|</main>",
    "<main {}><article>|</article></main>",
    '<div class="content" {}>|</div>',
    '<div id="content" {}>|</div>',
    '<div class="post entry-content" {}>|</div>',
    '<div class="article-body" {}>|</div>',
    '<section class="article text" {}>|</section>',
    '<div role="main" class="main-content" {}>|</div>',
    '<div class="story" {}>|</div>',
    '<table><tr><td class="main body" {}>|</td></tr></table>',
    "<article {}><div class=\"post-content\">|</div></article>",
)
BLOCKS = (
    "<p>{long}</p>",
    "<p>{long}</p>",
    "<p>{long}</p>",
    "<p>{short}</p>",
    "<p><b>{short}<br>",
    "<h2>{short}</h2>",
    "<h3>{short}</h3>",
    "<ul><li>{short}</li><li>{long}</li></ul>",
    "<ol><li>{short}</li><li>{short}</li></ol>",
    "<blockquote><p>{long}</p></blockquote>",
    "<blockquote>{long}</blockquote>",
    "<pre>{short}</pre>",
    "<table><thead><tr><th>{word}</th></tr></thead><tbody><tr><td>{word}</td><td>{short}</td></tr></tbody></table>",
    "<dl><dt>{word}</dt><dd>{long}</dd></dl>",
    "<figure><figcaption>{short}</figcaption></figure>",
    "<section><h3>{short}</h3><p>{long}</p></section>",
    "<div>{long}</div>",
    "<div class=\"text\"><p>{long}</p><p>{short}</p></div>",
    "<p>{long} <a href=\"/x\">{word}</a> {short}</p>",
)
OFF = (
    "<nav {}><ul><li><a href=\"/a\">{word}</a></li><li><a href=\"/b\">{word}</a></li></ul></nav>",
    "<nav class=\"menu\" {}><a href=\"/a\">{word}</a> <a href=\"/b\">{word}</a></nav>",
    "<header {}><h1>{short}</h1><p>{long}</p></header>",
    "<header class=\"site-header\" {}><a href=\"/\">{word}</a><p>{short}</p></header>",
    "<footer {}>{long}</footer>",
    "<footer class=\"page-footer\" {}><p>{short}</p><ul><li><a href=\"/p\">{word}</a></li></ul></footer>",
    "<aside {}><h3>{word}</h3><p>{long}</p></aside>",
    "<aside class=\"sidebar related\" {}><ul><li><a href=\"/c\">{short}</a></li></ul></aside>",
    "<form {}><label>{word}</label><input name=\"q\"><p>{short}</p><button>{word}</button></form>",
    "<form class=\"search\" {}><p>{long}</p><select><option>{word}</option></select></form>",
) + tuple(
    f'<{tag} class="{name}" {{}}>{inner}</{tag}>'
    for name in (
        "ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "sidebar", "widget", "menu", "nav", "navigation", "header", "footer",
        "cookie", "cookie-banner", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login",
        "comments", "comment", "user-comments", "reader-comments", "comment-list", "replies", "responses", "disqus", "discussion",
        "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "copyright", "toolbar", "tags",
    )
    for tag, inner in (
        ("div", "<p>{long}</p>"),
        ("div", "{long}"),
        ("section", "<h2>{short}</h2><p>{long}</p><p>{short}</p>"),
        ("div", "<ul><li><a href=\"/r\">{short}</a></li><li>{short}</li></ul>"),
    )
) + (
    "<section class=\"comments\" {}><h2>{short}</h2><article class=\"comment\"><p>{long}</p></article><article class=\"comment\"><p>{short}</p></article></section>",
    "<div id=\"comments\" {}><h3>{short}</h3><div class=\"comment\"><p>{long}</p></div><ol><li class=\"comment\"><p>{long}</p></li></ol></div>",
    "<p class=\"copyright\" {}>{short}</p>",
    "<p class=\"notice\" {}>{long}</p>",
    "<ul class=\"menu\" {}><li><a href=\"/m\">{word}</a></li><li><a href=\"/n\">{word}</a></li></ul>",
)


def pages(count: int = 600, seed: int = 11) -> list[str]:
    rng = random.Random(seed)

    def say(low: int, high: int) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + rng.choice((".", "", "."))

    def fill(part: str, mark: str) -> str:
        part = part.replace("{}", mark)
        for name, low, high in (("long", 8, 70), ("short", 1, 7), ("word", 1, 1)):
            while "{" + name + "}" in part:
                part = part.replace("{" + name + "}", say(low, high), 1)
        return part

    out = []
    for i in range(count):
        inside = [fill("<h1>{short}</h1>", "")] if rng.random() < 0.7 else []
        for _ in range(rng.randint(1, 8)):
            inside.append(fill(rng.choice(BLOCKS), ""))
            if rng.random() < 0.12:
                inside.append(fill(rng.choice(OFF), "data-off=1"))
        opening, closing = SHELLS[i % len(SHELLS)].replace("{}", "data-main=1").split("|")
        around = [fill(rng.choice(OFF), "data-off=1") for _ in range(rng.randint(0, 6))]
        cut = rng.randint(0, len(around))
        body = "\n".join([*around[:cut], opening + "".join(inside) + closing, *around[cut:]])
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(("wrapper", "page", "container", "layout"))}">{body}</div>'
        out.append(f"<html><head><title>{say(2, 5)}</title></head><body>{body}</body></html>")
    return out
