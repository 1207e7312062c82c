"""Small linked sites, generated from a rule."""

from pagelake.schemas import SNAPSHOT

SHOP = "http://www.tea.example"
DEEP = "http://deep.example"
ELSEWHERE = "http://elsewhere.example/"

TEAS = ["assam", "ceylon", "darjeeling", "keemun", "yunnan"]
POTS = ["clay", "glass", "iron", "porcelain", "silver"]


def shop_page(title, content):
    return f"""<!DOCTYPE html>
<html lang="en"><head><title>{title}</title><style>h1 {{color: teal}}</style></head>
<body><div id="page">
  <header>
    <h1 id="logo"><a href="/">Tea House</a></h1>
    <form action="/find"><label for="q">Find</label><input id="q" name="q" /></form>
    <a href="/fr">Français</a>
    <ul id="menu">
      <li class="entry first"><a class="item" href="/">Start</a></li>
      <li class="entry"><a class="item"
          href="/goods/teas.html">Teas</a></li>
      <li class="entry"><a class="item" href="/goods/pots.html">Pots</a></li>
      <li class="entry"><a href="/about.html">About</a></li>
      <li class="entry"><a href="/contact.html">Contact</a></li>
    </ul>
  </header>
  <!-- <a href="/hidden.html">not a link</a> -->
  <h1 id="page-title">{title}</h1>
  <div id="content">{content}</div>
  <footer>&copy; 2024, Tea House &amp; Co.</footer>
</div><script>var a = '<a href="/script.html">';</script></body></html>"""


def shop_pages():
    """13 pages: a start page, two overviews, and five pages below each."""
    pages = [(f"{SHOP}/index.html", shop_page(
        "Tea House", f'<p>We sell tea\n and pots!</p><a href="{ELSEWHERE}">Friends</a>'))]
    for kind, names in (("teas", TEAS), ("pots", POTS)):
        listing = "".join(f'<li><a href="/{name}.html">{name.title()}</a></li>' for name in names)
        pages.append((f"{SHOP}/goods/{kind}.html", shop_page(f"Tea House: {kind}", f"<ul>{listing}</ul>")))
        for name in names:
            rows = "".join(
                f'<div><span id="{label}-label">{label}:</span> <span class="value">{name} {label}</span></div>'
                for label in ("origin", "maker", "grade")
            )
            note = f'<p id="description">\n  A fine {name}.\n</p>'
            pages.append((f"{SHOP}/{name}.html", shop_page(f"Tea House: {name}", rows + note)))
    return pages


def deep_pages():
    """21 pages: a start page, then ten levels of two pages, each linking to both below."""
    def page(title, below):
        links = "".join(f'<a href="nested-{below}{side}.html">{side}</a> ' for side in "ab")
        return f"<html><head><title>{title}</title></head><body>{links}</body></html>"

    pages = [(f"{DEEP}/index.html", page("Nested", 0))]
    for level in range(10):
        for side in "ab":
            pages.append((f"{DEEP}/nested-{level}{side}.html", page(f"Nested {level}", level + 1)))
    return pages


def elsewhere_pages():
    return [(ELSEWHERE, "Nothing to see here")]


def snapshot(spark, pages):
    rows = [(uri, [uri], 200, {}, body) for uri, body in pages]
    return spark.createDataFrame(rows, SNAPSHOT)
