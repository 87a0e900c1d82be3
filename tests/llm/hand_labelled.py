"""Pages written and labelled by hand, in the manner of common site kinds: (html, main text)."""

NEWS = """<!DOCTYPE html><html lang="en"><head><title>Harbour bridge reopens - The Daily Tide</title>
<meta charset="utf-8"><style>.ad{display:block}</style><script>var t = "<p>not text</p>";</script></head>
<body class="article-page"><a class="skip-link" href="#content">Skip to content</a>
<header class="site-header"><div class="logo"><a href="/">The Daily Tide</a></div>
<nav class="main-nav"><ul><li><a href="/world">World</a></li><li><a href="/city">City</a></li><li><a href="/sport">Sport</a></li></ul></nav>
<form class="search" action="/s"><input name="q"><button>Search</button></form></header>
<div class="breadcrumb"><a href="/">Home</a> &rsaquo; <a href="/city">City</a></div>
<main id="content"><article class="story">
<h1>Harbour bridge reopens after nine months of repairs</h1>
<p>The old harbour bridge opened to traffic again on Monday morning, nine months after inspectors found cracks in two of its main cables.</p>
<p>Engineers replaced forty&nbsp;metres of steel and strengthened the eastern pier. &ldquo;It will outlive all of us,&rdquo; said the chief engineer.</p>
<h2>What comes next</h2>
<p>The city council will decide in the spring whether <a href="/trams">trams</a> may use the bridge, which carried them until 1961.</p>
<ul><li>Cars and buses may cross at once.</li><li>Lorries over ten tonnes have to wait until the final load test in June.</li></ul>
</article>
<aside class="related sidebar"><h3>Related stories</h3><ul><li><a href="/1">Ferry fares rise</a></li><li><a href="/2">Port plans new pier</a></li></ul></aside>
<div class="newsletter-signup"><p>Get our newsletter in your inbox every morning.</p><form><input type="email"><button>Subscribe</button></form></div>
<section id="comments" class="comments"><h3>2 comments</h3><div class="comment"><p class="author">gull77</p><p>About time, I had to drive around the bay every single day for most of a year!</p></div>
<div class="comment"><p>They should have built a tunnel instead of patching that thing up again.</p></div></section>
</main>
<footer class="site-footer"><p>&copy; 2024 The Daily Tide. All rights reserved.</p><ul><li><a href="/privacy">Privacy</a></li><li><a href="/terms">Terms</a></li></ul></footer>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience on our site.</p><button>Accept</button></div></body></html>"""

NEWS_TEXT = """Harbour bridge reopens after nine months of repairs
The old harbour bridge opened to traffic again on Monday morning, nine months after inspectors found cracks in two of its main cables.
Engineers replaced forty metres of steel and strengthened the eastern pier. “It will outlive all of us,” said the chief engineer.
What comes next
The city council will decide in the spring whether trams may use the bridge, which carried them until 1961.
Cars and buses may cross at once.
Lorries over ten tonnes have to wait until the final load test in June."""

BLOG = """<html><body><div id="wrapper"><div id="header"><h1 class="blog-title"><a href="/">Crumbs and Crusts</a></h1>
<div id="menu"><a href="/about">About</a> | <a href="/archive">Archive</a> | <a href="/contact">Contact</a></div></div>
<div id="main"><div class="post"><h2 class="post-title">Rye bread without a mixer</h2>
<p>My grandmother never owned a mixer, and her rye loaf was better than any that I have bought since.
<p>Stir the flour, the water and a spoon of sour starter until no dry flour is left, then leave the bowl alone overnight.
<blockquote>Patience is the only kneading that rye needs.</blockquote>
<p>Bake it for an hour on the lowest shelf, and do not cut it before the next day.</div>
<div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a> <a href="#">Pin it</a></div></div>
<div id="sidebar"><div class="widget"><h3>Recent posts</h3><ul><li><a href="/a">Oat cakes</a><li><a href="/b">Plum jam</a></ul></div>
<div class="widget ad"><p>Sponsored: buy the new oven today and save a lot.</p></div></div>
<div id="footer">Powered by a blog engine. <a href="/login">Log in</a></div></div></body></html>"""

BLOG_TEXT = """Rye bread without a mixer
My grandmother never owned a mixer, and her rye loaf was better than any that I have bought since.
Stir the flour, the water and a spoon of sour starter until no dry flour is left, then leave the bowl alone overnight.
Patience is the only kneading that rye needs.
Bake it for an hour on the lowest shelf, and do not cut it before the next day."""

MANUAL = """<html><head><title>tidy(1)</title></head><body>
<nav class="toc"><ul><li><a href="#syn">Synopsis</a></li><li><a href="#opt">Options</a></li></ul></nav>
<section class="content"><h1 id="syn">Tidying a directory</h1>
<p>The command reads every file below a directory and writes a sorted list of their sizes to the terminal.</p>
<pre>tidy [-r] directory</pre>
<h2 id="opt">Options</h2>
<table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-r</td><td>Reverse the order, so that the largest files come first in the list.</td></tr></table>
</section><footer><p>Last updated in May. <a href="/edit">Edit this page</a></p></footer></body></html>"""

MANUAL_TEXT = """Tidying a directory
The command reads every file below a directory and writes a sorted list of their sizes to the terminal.
tidy [-r] directory
Options
Option
Meaning
-r
Reverse the order, so that the largest files come first in the list."""

PAGES = [(NEWS, NEWS_TEXT), (BLOG, BLOG_TEXT), (MANUAL, MANUAL_TEXT)]
