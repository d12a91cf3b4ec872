"""Labelled web pages made by rule: layouts with known main text, for training and tests."""

from __future__ import annotations

import html
import random

from countermill.llm.dom_blocks import Block, blocks

SYLLABLES = "ka ro mi ten sul ve da lor pim ash ent or tis ben qua lo ri mun ster el".split()
#: Containers of the main text, of what stands around it, and their opening and closing markup.
MAIN = (
    "<article>{}</article>",
    "<main><article>{}</article></main>",
    "<main>{}</main>",
    '<article class="post">{}</article>',
    '<div id="content">{}</div>',
    '<div class="main-content">{}</div>',
    '<div class="entry-content">{}</div>',
    '<div class="article-body" itemprop="articleBody">{}</div>',
    '<section class="story post-body">{}</section>',
    '<div role="main"><div class="text">{}</div></div>',
    '<table><tr><td class="main">{}</td></tr></table>',
    '<div class="page"><div class="body">{}</div></div>',
)
MENUS = ("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="navbar">{}</ul>', '<div class="breadcrumbs"><ul>{}</ul></div>', '<header><nav><ul>{}</ul></nav></header>')
HEADS = ("<header>{}</header>", '<div id="header">{}</div>', '<div class="masthead site-header">{}</div>')
SIDES = ("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="right-column" class="widget">{}</div>', '<div class="related-posts">{}</div>', '<aside class="promo">{}</aside>')
ADS = ('<div class="ad">{}</div>', '<div class="advert banner">{}</div>', '<div class="sponsored">{}</div>', '<ins class="adsbygoogle">{}</ins>', '<div id="ads"><p>{}</p></div>')
NOTICES = ('<div class="cookie-banner">{}</div>', '<div class="notice" role="alert">{}</div>', '<div id="consent"><p>{}</p></div>', '<div class="popup newsletter"><p>{}</p></div>', '<div class="alert">{}</div>')
FOOTS = ("<footer>{}</footer>", '<div id="footer">{}</div>', '<div class="site-footer copyright">{}</div>')
COMMENTS = ('<div id="comments">{}</div>', '<section class="comments">{}</section>', '<ol class="comment-list">{}</ol>', '<div class="discussion replies">{}</div>', '<div class="user-comments">{}</div>')


class Maker:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.number = 0

    def one(self, choices):
        return self.random.choice(choices)

    def word(self) -> str:
        return "".join(self.one(SYLLABLES) for _ in range(self.random.randint(1, 3)))

    def prose(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.random.randint(low, high))]
        for i in range(len(words)):
            if self.random.random() < 0.1:
                words[i] += self.one((".", ",", ";", " &amp;", "."))
        self.number += 1
        return f"{' '.join(words).capitalize()} {self.number}{self.one(('.', '.', '.', '', '!'))}"

    def links(self, n: int, wrap: str = "<li>{}</li>") -> str:
        return "".join(wrap.format(f'<a href="/{self.word()}">{self.prose(1, 3)}</a>') for _ in range(n))

    def paragraph(self, text: str) -> str:
        if self.random.random() < 0.15:
            words = text.split(" ")
            words[0] = self.one((f"<b>{words[0]}</b>", f'<a href="#">{words[0]}</a>', f"<i>{words[0]}", f"<b>{words[0]}"))
            text = " ".join(words)
        return self.one(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p>{}<br>")).format(text)

    def main(self) -> tuple[str, list[str]]:
        texts: list[str] = []

        def keep(text: str) -> str:
            texts.append(text)
            return text

        parts = [f"<h1>{keep(self.prose(3, 10))}</h1>"] if self.random.random() < 0.8 else []
        for _ in range(self.random.randint(1, 9)):
            kind = self.random.random()
            if kind < 0.7:
                parts.append(self.paragraph(keep(self.prose(*self.one(((2, 8), (10, 40), (30, 120)))))))
            elif kind < 0.78:
                parts.append(f"<h2>{keep(self.prose(2, 6))}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{keep(self.prose(2, 14))}</li>" for _ in range(self.random.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{keep(self.prose(8, 30))}</blockquote>")
            else:
                parts.append(self.one((*ADS, *SIDES)).format(self.prose(2, 20)))
        return "".join(parts), texts

    def page(self) -> tuple[str, list[str]]:
        body, texts = self.main()
        side = lambda: f"<h3>{self.prose(1, 3)}</h3><ul>{self.links(3)}</ul><p>{self.prose(3, 30)}</p>"
        maybe = lambda chance, made: made() if self.random.random() < chance else ""
        form = lambda: f"<form><label>{self.prose(1, 4)}</label><input name=q><button>{self.prose(1, 2)}</button></form>"
        comment = lambda: self.one(('<div class="comment"><p>{}</p></div>', '<li class="comment">{}</li>', "<p>{}</p>")).format(self.prose(4, 60))
        around = [
            maybe(0.6, lambda: self.one(HEADS).format(f"<h1>{self.prose(1, 3)}</h1><p>{self.prose(2, 8)}</p>")),
            maybe(0.9, lambda: self.one(MENUS).format(self.links(self.random.randint(3, 8)))),
            maybe(0.4, lambda: self.one(NOTICES).format(self.prose(4, 25))),
            maybe(0.6, lambda: self.one(ADS).format(self.prose(2, 30))),
            maybe(0.3, lambda: self.one(SIDES).format(side())),
            maybe(0.3, form),
            self.one(MAIN).format(body),
            maybe(0.3, form),
            maybe(0.4, lambda: self.one(SIDES).format(side())),
            maybe(0.5, lambda: self.one(COMMENTS).format("".join(comment() for _ in range(self.random.randint(1, 5))))),
            maybe(0.3, lambda: self.one(ADS).format(self.prose(2, 30))),
            maybe(0.8, lambda: self.one(FOOTS).format(f"<p>{self.prose(2, 14)}</p>{self.links(self.random.randint(0, 3), '{} ')}")),
        ]
        head = f"<!DOCTYPE html><html><head><title>{self.prose(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        return head + "".join(around) + self.one(("</body></html>", "")), [" ".join(html.unescape(t).split()) for t in texts]


def labelled_pages(seed: int, n: int) -> list[tuple[list[Block], list[bool]]]:
    """Pages as blocks with their labels. Every text ends with a number of its own, so blocks name themselves."""
    out, maker = [], Maker(seed)
    for _ in range(n):
        page, texts = maker.page()
        found, main = blocks(page), set(texts)
        out.append((found, [b.text in main for b in found]))
    return out
