"""Labelled pages for the extraction model: `main` marks an element whose own text is the page's main text (of body, its loose text)."""

_WRITTEN = [
    """<html><head><title>t</title></head><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>
    <div class="ad">Buy now</div><article main><h1 main>Head</h1><p main>One two <a href=c>three</a> four.</p><p main>Five.</p></article>
    <footer>&copy; us</footer></body></html>""",
    """<html><body><header><h1>Site</h1><p>Tagline</p><form><label>Search</label><input></form></header><div class="menu"><ul><li><a href=a>A</a></li></ul></div>
    <main main><h1 main>Head</h1><p main>Text.</p><h2 main>Part</h2><p main>More.</p><ul main><li main>Item</li><li main>Item two</li></ul></main>
    <aside><h3>Related</h3><ul><li><a href=x>X</a></li></ul><p>Follow us</p></aside><footer><p>Imprint</p><ul><li><a href=i>Imprint</a></li></ul></footer></body></html>""",
    """<html><body><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><div id="sidebar"><h2>Popular</h2><p>Links</p></div>
    <div id="content" main><h1 main>Head</h1><blockquote main><p main>Quote.</p></blockquote><p main>Text.</p><pre main>code</pre></div>
    <section class="comments"><h2>Comments</h2><article class="comment"><p>Nice</p></article><div class="comment"><p>No</p></div></section></body></html>""",
    """<html><body><nav><p>You are here</p><div><a href=a>Home</a></div></nav><div class="post" main><h2 main>Head</h2><div class="text" main><p main>Text.</p><table main><tr main><td main>1</td></tr></table></div></div>
    <div class="advert"><p>Ad</p><div>Ad two</div></div><div class="share"><ul><li><a href=s>Share</a></li></ul></div><form class="newsletter"><p>Sign up</p><div>Mail</div></form>
    <div id="footer"><div>All rights</div></div></body></html>""",
    """<html><body><article main><header main><h1 main>Head</h1></header><p main>Text.</p><div main>Loose text.</div><aside><p>Aside</p></aside><div class="ad"><p>Ad</p></div><figure main><figcaption main>Caption</figcaption></figure><section main><h3 main>More</h3><p main>Text.</p></section></article>
    <section id="comments"><ol><li><p>Reader</p></li></ol><form><p>Write</p></form></section><div class="banner notice">Notice</div></body></html>""",
    """<html><body><article main><h1 main>Head</h1><p main>Text.</p><aside><p>Aside</p><ul><li><a href=a>A</a></li></ul></aside><p main>More.</p><div class="sidebar"><p>Side</p></div><div class="notice">Note</div><p main>End.</p><form><p>Vote</p></form></article></body></html>""",
    """<html><body><header><p>Site</p></header><p main>Text in the page itself.</p><p main>Two.</p><ul main><li main>Item</li></ul><footer><p>Foot</p></footer></body></html>""",
    """<html><body><h1 main>Head</h1><p main>Text.</p><div main>Loose.</div><div class="comments"><p>Reader</p><div class="comment">Reader two</div><form><div>Reply</div></form></div></body></html>""",
    """<html><body><main main><article main><h2 main>Head</h2><p main>Text.</p><ul main><li main>One</li><li main>Two</li></ul><nav><ul><li><a href=n>Next</a></li></ul></nav></article><section class="comments"><h3>Replies</h3><article><p>Reader</p></article><article><p>Reader</p></article></section></main>
    <footer><div><p>Foot</p></div></footer></body></html>""",
    """<html><body><nav><a href=a>A</a></nav><div class="banner"><p>Sale</p></div><div main><p main>Text.</p><p main>Two.</p></div><div class="related"><h3>More</h3><p><a href=m>M</a></p></div><aside><div>Side</div></aside></body></html>""",
    """<html><body><article main><header main><h1 main>Head</h1></header><div class="body" main><p main>Text.</p><p main><a href=l>Linked</a></p><dl main><dt main>T</dt><dd main>D</dd></dl><ol main><li main>One</li></ol></div><footer>By us</footer><div class="ad">Ad</div><div class="ads"><p>Ad</p></div></article>
    <div class="cookie"><div>Cookies</div></div></body></html>""",
    """<html><body><article main><p main>Short.</p><aside><p>A</p></aside><div class="sidebar"><p>S</p></div><div class="notice">N</div><div class="ad">Ad</div><nav><a href=n>N</a></nav><form><p>F</p></form></article></body></html>""",
    """<html><body><main main><h1 main>H</h1><div class="share">S</div><div class="advert">A</div><aside>A</aside><div class="newsletter"><p>Mail</p></div><section id="comments"><p>C</p></section></main></body></html>""",
    """<html><body><article main><h2 main>H</h2><p main>T</p><div class="promo">P</div><div class="popup">P</div><div class="related"><p>R</p></div><footer><p>By</p></footer><div class="comments"><article><p>C</p></article></div></article></body></html>""",
    """<html><body><header><h1>Site</h1><nav><a href=a>A</a></nav></header><article main><h1 main>H</h1><p main>T</p></article><footer><h3>About</h3></footer></body></html>""",
    """<html><body><header><h1>Site</h1></header><main main><h2 main>H</h2><p main>T</p></main><aside><h2>More</h2></aside></body></html>""",
    """<html><body><header><div><h1>Site</h1><h2>Line</h2></div></header><div id="main" main><h1 main>H</h1><p main>T</p></div><footer><p>F</p></footer></body></html>""",
]

_LONG, _LINE, _SHORT = "long text " * 25, "a line of it " * 4, "few words"
_LINKS = "<a href=a>Home</a> <a href=b>News</a> <a href=c>Archive</a>"
_LIST = "<ul><li><a href=a>One of these</a></li><li><a href=b>Two</a></li><li><a href=c>Another page</a></li></ul>"
#: What holds the main text, what it is made of, and what stands before and after it: each holder is combined with each content.
_HOLDERS = [
    "<article main>{}</article>", "<main main>{}</main>", "<div main>{}</div>", "<div id=x12 main>{}</div>", "<div main><div main>{}</div></div>", "<section main>{}</section>",
    "<table main><tr main><td main>{}</td></tr></table>", "{}", '<div class="content" main>{}</div>', "<div main><article main><div main>{}</div></article></div>",
]
_CONTENTS = [
    f"<h1 main>{_SHORT}</h1><p main>{_LONG}</p><p main>{_LINE}</p><p main>{_LONG}<a href=a>link</a></p>",
    f"<p main>{_LINE}</p><p main>{_LONG}</p><p main>{_SHORT}</p>",
    f"<h2 main>{_SHORT}</h2><div main>{_LONG}</div><div main>{_LINE}</div>",
    f"<h1 main>{_LINE}</h1><div main><div main><p main>{_LINE}</p></div><p main>{_LONG}</p></div><div main><p main>{_SHORT}</p></div>",
    f"<h1 main>{_SHORT}</h1><p main>{_LONG}</p><ul main><li main>{_SHORT}</li><li main>{_LINE}</li></ul><table main><tr main><td main>{_SHORT}</td><td main>1</td></tr></table>",
    f"<h1 main>{_SHORT}</h1><p main>{_LINE}<span class=ad>{_SHORT}</span>{_LONG}</p><blockquote main><p main>{_LINE}</p></blockquote><pre main>{_LINE}</pre>",
    f"<p main>{_SHORT}</p>",
    f"<section main><h2 main>{_SHORT}</h2><p main>{_LONG}</p></section><section main><h2 main>{_SHORT}</h2><p main>{_LINE}<em class=note main>{_SHORT}</em></p></section>",
]
_AROUND = [
    ("", ""),
    (f"<nav>{_LIST}</nav>", f"<footer><p>{_LINE}</p></footer>"),
    (f'<div class="menu">{_LINKS}</div><div class="cookie-notice"><p>{_LINE}</p></div>', f'<div class="comments"><h3>{_SHORT}</h3><div class="comment"><p>{_LONG}</p></div></div><div id="footer">{_LINE}</div>'),
    (f"<header><h1>{_SHORT}</h1><p>{_LINE}</p></header>", f"<aside><h3>{_SHORT}</h3>{_LIST}</aside><form><p>{_LINE}</p></form>"),
    (f"<div>{_LINKS}</div>", f"<div>{_LIST}</div>"),
    (f'<div class="ad">{_LONG}</div>', f'<div class="newsletter"><p>{_LINE}</p></div><div><div>{_LIST}</div></div>'),
    (f'<div class="banner">{_LINE}</div><div id="sidebar"><h2>{_SHORT}</h2><p>{_LONG}</p></div>', f"<p>{_LINKS}</p>"),
]


def _composed() -> list[str]:
    out = []
    for i, holder in enumerate(_HOLDERS):
        for j, content in enumerate(_CONTENTS):
            before, after = _AROUND[(i + 3 * j) % len(_AROUND)]
            page = before + holder.format(content) + after
            out.append(page if (i + j) % 3 == 0 else f"<html><body>{page}</body></html>")
    loose = [f"{_LONG}", f"{_SHORT}<br>{_LINE}", f"<h1 main>{_SHORT}</h1>{_LONG}<br><br>{_LONG}", _SHORT]
    return out + [f"<body main>{before}{x}{after}</body>" for k, x in enumerate(loose) for before, after in _AROUND[k % 2 :: 2]] + [f"<body main>{x}</body>" for x in loose]


LABELLED_PAGES = _WRITTEN + _composed()
