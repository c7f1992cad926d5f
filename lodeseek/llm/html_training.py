"""The small labelled table for html_extract.py: pages in parts, each with 1 where it is main text.

Written for this purpose: layouts with and without an article tag, and both short and long texts on either side.
"""

_SHORT = ["Rain again.", "See below.", "It was late, and the road was empty.", "They left at noon.", "No."]
_LONG = [
    "The river had risen overnight, and by morning the lower fields were under a brown sheet of water that reached the old mill and the first houses of the village.",
    "Measurements taken over eleven years show that the shift began earlier than was thought, although the causes are still a matter of debate among those who study it.",
    "She kept the letters in a tin box, sorted by year, and read them only when the house was quiet, which in those days was seldom enough to make it an occasion.",
    "In the second part of the experiment the two groups changed places, so that each served as a check on the other, and the results agreed to within a few percent.",
]
_NOTICE = "We use small files on your device to keep the site running and to learn how it is used. You can change your choice at any time in the settings of your account."
_REMARK = "I read this twice and still don't agree with the second paragraph, since the figures that are given there leave out the whole of the northern district, as far as I can see."
_FINE_PRINT = "All texts and pictures on these pages belong to their owners. Reprinting, even in part, needs written consent, and requests should be sent to the office by post."


def _menu(*names: str) -> str:
    return "<ul>" + "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names) + "</ul>"


def _p(*texts: str) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


_LINES = ["Home", "The valley post", "Monday", "Sign in", "About us", "Terms", "Printed weekly", "Call 555", "Back to top", "Next page", "Older", "All rights reserved"]
_TITLES = ["Fields under water", "A box of old letters", "What the second part of the study says", "The mill is for sale again", "How the road came to be empty"]


def _unnamed(n: int) -> list[tuple[str, int]]:
    """A page of which neither tags nor names tell what is what: only its words, its links and what stands beside them do."""
    box, line = (("div", "div"), ("p", "p"), ("td", "td"), ("section", "p"), ("div", "span"))[n % 5]
    row = lambda *x: "".join(f"<{box}>{t}</{box}>" for t in x)
    link = lambda t: f"<a href='/{len(t)}'>{t}</a>"
    short, long = _SHORT[n % 5 :] + _SHORT[: n % 5], _LONG[n % 4 :] + _LONG[: n % 4]
    at = 3 * n % len(_LINES)
    lines = (_LINES[at:] + _LINES[:at])[: 3 + n % 3]
    top = row(*(link(x) for x in lines)) if n % 3 else row(" | ".join(link(x) for x in lines))
    if n % 2:
        top += row(lines[0], lines[1])
    head = "" if n % 7 == 3 else f"<h1>{_TITLES[n % 5]}</h1>" if n % 4 else row(_TITLES[n % 5])
    if not head:  # a line of links directly before the text
        top += row(" | ".join(link(x) for x in lines * (1 + 3 * (n % 3))))
    body = [long[0], f"{long[1]} {link('the map')} {long[2]}" if n % 2 else f"{link(long[1][:70])}{long[1][70:]} {link(long[2][:20])}{long[2][20:]}", short[0] if n % 2 else long[3], long[2], f"{link(long[3][:80])}{long[3][80:]}" if n % 3 else f"{short[2]} {short[3]} {short[1]}", long[1]][: 4 + n % 3]
    if n % 4 == 1:
        body[2:2] = [_TITLES[n % 5] + ", as it was.", short[2], short[1]]
    if n % 3 == 2:
        body += [_TITLES[(n + 2) % 5] + ", they said."]
    more = row(*(link(t) for t in _TITLES[n % 3 : n % 3 + 3])) if n % 2 else row(*(f"{link(t)} {lines[0]}" for t in _TITLES[n % 2 : n % 2 + 3]))
    if n % 3 == 1:
        more += row(*(link(f"{t}, and {_TITLES[n % 5].lower()}, with {_TITLES[(n + 1) % 5].lower()}") for t in _TITLES[:2]))
    if n % 5 == 2:
        more += row(" ".join(link(x) for x in _LINES * 2))
    foot = row(*lines[: 2 + n % 2])
    if n % 4 > 1:  # what stands around is named, the article isn't
        top = f"<nav>{top}</nav><div class='ad'>{short[3] if n % 3 else long[3]}</div>" if n % 2 else f"<div id='cookie-notice'>{_NOTICE}</div><header>{top}</header>"
        more = f"<div class='ad'>{(short[2], lines[0], long[0])[n % 3]}</div>" + (f"<aside>{more}</aside>" if n % 3 else "")
        foot = f"<footer>{(_FINE_PRINT, '&copy; The Post of the valley, &middot; ' + short[2], lines[1])[n % 3]}</footer>"
    return [("<body>" + top, 0), (head + "".join(f"<{line}>{t}</{line}><hr>" if line == "span" else f"<{line}>{t}</{line}>" for t in body), 1), (more + foot, 0)]


def _sources(n: int) -> list[tuple[str, int]]:
    """A page whose article has linked headings, paragraphs and lists, and short lines side by side."""
    opened, closed = (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='entry-content'>", "</div>"), ("<div role='main'>", "</div>"))[n % 4]
    link = lambda t: f"<a href='/{len(t)}'>{t}</a>"
    title = f"<h1>{link(_TITLES[n % 5]) if n % 2 else _TITLES[n % 5]}</h1>"
    sources = _p(link(_LONG[n % 4]), _SHORT[4], _SHORT[n % 3]) + "<ul>" + "".join(f"<li>{link(t)}</li>" for t in _TITLES[n % 3 :]) + "</ul>" + _p(link("Map"), _SHORT[(n + 1) % 4], *[_SHORT[4], _SHORT[0], _SHORT[1]][: n % 4])
    side = f"<aside><p>{_LONG[(n + 1) % 4]}</p>{_menu('older', 'newer')}</aside>" if n % 3 else f"<div class='sidebar'>{_p(link(_TITLES[1]), _LONG[0])}</div>"
    foot = (f"<footer><p>{_FINE_PRINT}</p>{_menu('terms', 'contact')}</footer>", "<footer>Imprint</footer>", "<div>Imprint</div>")[n // 3 % 3]
    after = "" if n % 5 > 2 else foot if n % 5 else side + foot
    top = f"<div>{_NOTICE}</div>" if n % 4 == 1 else f"<div>{_TITLES[n % 5]}, now on sale.</div>" if n % 4 == 3 else ""
    after += f"<div>{_REMARK}</div>" if n % 6 == 2 else f"<p>{_FINE_PRINT}</p>" if n % 6 == 5 else ""
    return [("<body><nav>" + _menu(*_LINES[n % 5 : n % 5 + 4]) + "</nav>" + top, 0), (opened + title + _p(_LONG[(n + 2) % 4]) + sources + closed, 1), (after, 0)]


PAGES: list[list[tuple[str, int]]] = [
    *(_sources(n) for n in range(30)),
    *(_unnamed(n) for n in range(40)),
    [
        ("<html><head><title>Floods</title></head><body><nav>" + _menu("home", "news", "sport", "contact") + "</nav>", 0),
        ('<div class="ad">Buy three lamps and pay for two.</div>', 0),
        ("<article><h1>The flood of spring</h1>" + _p(_LONG[0], _SHORT[0], _LONG[1], _SHORT[1]) + "</article>", 1),
        ("<footer>&copy; The Valley Post &middot; Printed weekly.</footer></body></html>", 0),
    ],
    [
        ("<body><nav>" + _menu("a", "b") + "</nav><div class='ad'>" + _LONG[3] + "</div>", 0),
        ("<article><h1>Box</h1><p><b>" + _SHORT[2] + "<br>" + _p(_SHORT[3], _SHORT[4], _LONG[2]) + "</article>", 1),
        ("<footer>" + _FINE_PRINT + "</footer>", 0),
    ],
    [
        ('<body><header><a href="/">The Daily</a> since 1902</header>', 0),
        ("<main><h2>Letters</h2>" + _p(_LONG[2], _SHORT[3]) + "<ul><li>First point.</li><li>Second point, a little longer than the first.</li></ul>", 1),
        ('<aside class="related">' + _menu("older letters", "all letters by this writer") + "<p>" + _LONG[1] + "</p></aside>", 0),
        (_p(_SHORT[0], _LONG[3]) + "</main>", 1),
        ('<section class="comments"><h3>Comments</h3><div class="comment"><p>' + _REMARK + '</p></div><article class="comment"><p>Well said.</p></article></section>', 0),
        ("<form><label>Your name</label><p>Leave a remark of up to five hundred words below, and mind the tone.</p><button>Send</button></form>", 0),
    ],
    [
        ('<body><div id="cookie-notice">' + _NOTICE + "</div><div class='topbar'>" + _menu("login", "register") + "</div>", 0),
        ('<div id="content"><h1>On the experiment</h1>' + _p(*_LONG[1:], _SHORT[1]) + "<blockquote>" + _SHORT[2] + "</blockquote></div>", 1),
        ('<div class="sidebar"><h4>Most read</h4><p>' + _LONG[0] + "</p><p>Also today.</p></div>", 0),
        ('<div id="footer"><p>' + _FINE_PRINT + "</p></div></body>", 0),
    ],
    [
        ("<body><table><tr><td>" + _menu("index", "map", "help") + "</td></tr></table>", 0),
        ("<h1>Without a frame</h1>" + _p(_LONG[0], _LONG[1], _LONG[2]), 1),
        ("<p><a href='/next'>Next page</a> | <a href='/last'>Last page</a></p>", 0),
    ],
    [
        ("<body><p><a href='/'>Home</a> &gt; <a href='/n'>North</a></p>", 0),
        ("<h2>The mill</h2>" + _p(_LONG[3], _LONG[0], _LONG[2]), 1),
        ("<p><a href='/x'>More of this</a></p><p><a href='/y'>Write to us</a> or call</p>", 0),
        ('<div class="share">Share this with others, if you like it</div><div class="legal">' + _FINE_PRINT + "</div>", 0),
    ],
    [
        ('<body><div role="banner">A paper for the valley</div><div role="navigation">' + _menu("one", "two", "three") + "</div>", 0),
        ('<div class="post"><h1>Short</h1>' + _p(_SHORT[4], _SHORT[3], _SHORT[0]) + "<table><tr><td>Year</td><td>Level</td></tr><tr><td>1902</td><td>4 m</td></tr></table></div>", 1),
        ('<div class="newsletter"><p>' + _NOTICE + "</p></div><div class='promo'>Half price.</div>", 0),
    ],
    [
        ("<body><article><h1>Links in it</h1>", 1),
        ("<p>" + _LONG[0] + " See <a href='/m'>the map of the lower fields</a> for more.</p><p><a href='/s'>The study</a> says so.</p>" + _p(_LONG[1]), 1),
        ('<div class="social"><a href="/f">Send it on</a></div><div class="tags"><a href="/t">water</a> <a href="/u">fields</a></div>', 0),
        (_p(_SHORT[1], _LONG[2]) + "<ul><li><a href='/k'>A source that was used</a></li><li>Another source.</li></ul></article>", 1),
        ("<p>Printed by the valley press.</p><ul><li>About</li><li>Terms</li></ul>", 0),
    ],
    [
        ("<body><div>Skip</div><div>Menu</div><div><a href='/'>Start</a></div>", 0),
        ("<div><h1>Plain boxes</h1><div>" + _LONG[3] + "</div><div>" + _LONG[1] + "</div><div>" + _LONG[0] + "</div></div>", 1),
        ("<div>Imprint</div><div>Contact</div>", 0),
    ],
    [
        ('<body><div class="header"><p>' + _NOTICE + "</p></div><p>Advertisement</p>", 0),
        ('<article class="story"><header><h1>With a head</h1><p>By the desk.</p></header>' + _p(_SHORT[2], _LONG[2], _LONG[3]) + "<h2>Later</h2>" + _p(_SHORT[0]) + "</article>", 1),
        ('<div id="comments">' + _p(_REMARK, "Yes.", _LONG[1]) + "</div><div>Back to top</div>", 0),
    ],
    [
        ("<body class='single has-sidebar'><div id='page' class='with-sidebar'><nav>" + _menu("home", "post") + "</nav>", 0),
        ("<article class='post comments-open category-social'><h1>On the river</h1>" + _p(_LONG[0], _SHORT[0]) + "<div class='warning'><p>" + _LONG[3] + "</p></div>" + _p(_LONG[2]) + "</article>", 1),
        ("<div class='comments'>" + _p(_REMARK) + "</div></div>", 0),
    ],
    [
        ("<body><form id='page'><div class='header'><p>The valley</p></div>", 0),
        ("<div class='body'><h1>In a form</h1>" + _p(_LONG[1], _LONG[3], _SHORT[2]) + "</div>", 1),
        ("<div class='footer'><p>" + _FINE_PRINT + "</p></div></form></body>", 0),
    ],
]
