"""Hand-labelled page skeletons for the extraction model.

``y="1"`` marks an element as main content and ``y="0"`` as something else; an
element without the mark takes its parent's.  ``T`` stands for a sentence, ``P``
for a paragraph of them and ``L`` for a link of a few words.
"""

SEEDS = (
    """<html><body><header class="site-header" y="0"><a>L</a><nav class="main-nav"><ul><li><a>L</a></li><li><a>L</a></li>
    </ul></nav></header><div class="cookie-banner" y="0"><p>T <a>L</a></p><button>L</button></div><main><article y="1">
    <h1>T</h1><p>P</p><p>P <a>L</a> P</p><h2>T</h2><p>P</p><ul><li>T</li><li>T</li></ul><blockquote><p>P</p></blockquote>
    <div class="ad" y="0">T T</div><p>P</p></article><section id="comments" class="comments" y="0"><h2>L</h2>
    <div class="comment"><p>P</p></div><div class="comment"><p>T</p></div><form><label>L</label><input></form></section>
    </main><aside class="sidebar" y="0"><h3>L</h3><ul><li><a>L</a></li><li><a>L</a></li></ul></aside>
    <footer y="0"><p>T</p><a>L</a></footer></body></html>""",
    """<html><body><div id="top-menu" class="menu" y="0"><a>L</a><a>L</a><a>L</a></div><div id="content" y="1"><h1>T</h1>
    <div class="text"><p>P</p><p>P</p><p>T</p></div><table><tr><th>L</th><th>L</th></tr><tr><td>T</td><td>T</td></tr></table>
    <pre>P</pre><div class="share-buttons" y="0"><a>L</a><a>L</a></div></div><div id="related" class="related-posts" y="0">
    <h3>L</h3><p>T <a>L</a></p><p>T <a>L</a></p></div><div class="newsletter signup" y="0"><form><p>T</p><input></form></div>
    <div id="footer" y="0"><p>T</p><p>T</p></div></body></html>""",
    """<html><body><nav y="0"><ul><li><a>L</a></li><li><a>L</a></li><li><a>L</a></li></ul></nav><div class="ad" y="0">P</div>
    <article y="1"><h1>T</h1><p>P</p><p><b>P</b></p><p>P</p><p>T</p></article><footer y="0">T T</footer></body></html>""",
    """<html><body><nav y="0"><a>L</a><a>L</a></nav><article y="1"><h1>T</h1><p>T</p></article><aside y="0"><p>P</p><p>P</p>
    </aside><div class="advert banner" y="0">P P</div><footer y="0">T</footer></body></html>""",
    """<html><body><div class="wrapper"><div class="topbar" y="0"><p>T</p></div><div class="breadcrumb" y="0"><a>L</a><a>L</a>
    </div><div class="post" y="1"><h1>T</h1><div class="entry-content"><p>P</p><figure><img><figcaption>T</figcaption></figure>
    <p>P</p><div class="sponsored" y="0"><p>P</p></div><ol><li>T</li><li>T</li></ol><p>P</p></div></div>
    <div class="widget tags" y="0"><a>L</a><a>L</a></div><div id="disqus_thread" y="0"><div class="reply"><p>P</p></div>
    <div class="reply"><p>P</p></div></div></div><div class="copyright legal" y="0">T T</div></body></html>""",
    """<html><body><form class="search" y="0"><input><button>L</button></form><div role="alert" class="notice" y="0">T T</div>
    <main y="1"><section><h2>T</h2><p>P</p><dl><dt>L</dt><dd>T</dd></dl></section><section><h2>T</h2><p>P</p><p>P</p></section>
    </main><section class="discussion" y="0"><p>P</p><p>P</p></section><noscript y="0">T</noscript></body></html>""",
    """<html><body><header y="0"><h2>L</h2><p>T</p></header><article y="1"><header><h1>T</h1></header><p>P</p><div><p>P</p></div>
    <aside class="promo" y="0"><p>P</p></aside><p>P</p><form class="subscribe" y="0"><p>T</p><select><option>L</option></select>
    </form></article><section class="user-comments" y="0"><article class="comment"><p>P</p></article><article class="comment">
    <p>T</p></article></section><footer y="0"><ul><li><a>L</a></li></ul><p>T</p></footer></body></html>""",
    """<html><body><div class="banner ads" y="0">T</div><div class="story" y="1"><p>P</p><p>P</p><p>P</p></div>
    <div class="social share" y="0"><a>L</a></div><div class="popup modal" y="0"><p>T T</p></div></body></html>""",
    """<html><body y="1"><h1>T</h1><p>P</p><p>P</p><ul><li>T</li><li>T</li></ul><p>P</p><div class="footer" y="0">T <a>L</a></div>
    </body></html>""",
    """<html><body y="1"><div class="header" y="0"><a>L</a></div><h2>T</h2><div>P</div><div>P</div><div class="ads" y="0">P</div>
    <div>P</div><hr><div class="comments" y="0"><div>P</div></div></body></html>""",
)

#: A stand-in sentence and link; only lengths matter to the model.
SENTENCE = "Words of a sentence that runs on for a while and then stops."


def labelled_pages() -> list[str]:
    out = []
    for n, seed in enumerate(SEEDS):
        page = " ".join(seed.split())
        for mark, text in (("P", " ".join([SENTENCE] * (3 + n % 4))), ("T", SENTENCE), ("L", "A short link")):
            page = page.replace(f">{mark}<", f">{text}<").replace(f">{mark} ", f">{text} ").replace(f" {mark}<", f" {text}<")
        out.append(page)
    return out
