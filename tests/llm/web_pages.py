"""Hand-written pages of four layouts, with the blocks of their main text."""

# fmt: off
PAGES = [
    # a table layout without class names
    ("""<html><head><title>Rain gauge</title></head><body bgcolor=white><table width=100%><tr><td colspan=2><a href="/">Home</a> | <a href="/log">Log</a> | <a href="/map">Map</a></td></tr>
<tr><td width=120><a href="/2019">2019</a><br><a href="/2020">2020</a><br><a href="/2021">2021</a></td><td><h2>Building a rain gauge</h2><p>The gauge is a plain tube with a funnel on top. Water runs into the tube and a float lifts a pointer.</p>
<p>We cut the tube from a drain pipe. A saw with fine teeth leaves a clean edge, which matters because the funnel has to sit level.</p><ul><li>one drain pipe of 50 mm</li><li>one funnel of the same width</li></ul><p>After the first storm it read 12 mm, as did the station in town.</p></td></tr>
<tr><td colspan=2>Copyright 2021 The Weather Club</td></tr></table></body></html>""",
     ["Building a rain gauge", "The gauge is a plain tube with a funnel on top. Water runs into the tube and a float lifts a pointer.", "We cut the tube from a drain pipe. A saw with fine teeth leaves a clean edge, which matters because the funnel has to sit level.", "one drain pipe of 50 mm", "one funnel of the same width", "After the first storm it read 12 mm, as did the station in town."]),
    # a blog of nested divs with comments and a newsletter box
    ("""<html lang=en><body class="home"><div id="page"><div id="masthead"><div class="site-title"><a href="/">Slow Bread</a></div><p class="tagline">Notes from a small kitchen</p></div><div class="nav-menu"><ul><li><a href=/>Start</a><li><a href=/recipes>Recipes</a><li><a href=/about>About</a></ul></div>
<div id="content"><div class="post"><h1>Why dough rests</h1><p>Flour needs time to take up water. Within half an hour the dough turns from rough to smooth, though nobody touches it.</p><p>Bakers call this rest autolyse. It was described in the seventies and spread from there.</p>
<blockquote>Time does the work of hands.</blockquote><p>Salt goes in afterwards, since it tightens the dough.</p><div class="share-buttons"><a href=#>Share</a> <a href=#>Pin</a></div></div>
<div id="comments" class="comments-area"><h3>2 responses</h3><ol><li class="comment"><b>Ida</b><p>I always wondered about that. Thanks for the explanation!</p></li><li class="comment"><b>Tom</b><p>My dough stays rough even after an hour, what now?</p></li></ol></div></div>
<div class="sidebar"><div class="widget"><h3>Newsletter</h3><form><p>One mail a month, no adverts.</p><input><button>Join</button></form></div><div class="widget"><h3>Popular</h3><ul><li><a href=1>Rye in winter</a><li><a href=2>A stone for the oven</a></ul></div></div>
<div id="footer"><p>Slow Bread is written by two people and a dog.</p></div></div></body></html>""",
     ["Why dough rests", "Flour needs time to take up water. Within half an hour the dough turns from rough to smooth, though nobody touches it.", "Bakers call this rest autolyse. It was described in the seventies and spread from there.", "Time does the work of hands.", "Salt goes in afterwards, since it tightens the dough."]),
    # a news page with semantic elements, an advert in the text and a cookie box
    ("""<!doctype html><html><body><div class="consent-banner" role="dialog"><p>We value your privacy. Choose which cookies we may set.</p><button>Accept all</button></div><header><a href="/">The Harbour Post</a><nav><a href=/local>Local</a><a href=/sport>Sport</a></nav></header>
<main><article><h1>Ferry returns after repairs</h1><p class="byline">By Ana Ruiz, 3 May</p><p>The ferry between the two shores sails again from Monday. It had been in dock for eleven weeks because of cracks in the hull.</p><div class="ad-slot"><p>Advertisement</p><a href="//shop">Boots for every weather, now reduced</a></div>
<p>According to the operator, the work cost less than expected. &ldquo;We found fewer cracks than feared,&rdquo; its manager said.</p><h2>More trips in summer</h2><p>From June there will be two more trips a day.</p></article><aside class="related"><h2>Read on</h2><ul><li><a href=3>Bridge closed until autumn</a></li><li><a href=4>New harbour master named</a></li></ul></aside></main>
<footer><p>&copy; The Harbour Post. All rights reserved.</p><a href=/imprint>Imprint</a></footer><script>track("x")</script></body></html>""",
     ["Ferry returns after repairs", "By Ana Ruiz, 3 May", "The ferry between the two shores sails again from Monday. It had been in dock for eleven weeks because of cracks in the hull.", "According to the operator, the work cost less than expected. “We found fewer cracks than feared,” its manager said.", "More trips in summer", "From June there will be two more trips a day."]),
    # documentation with a table of contents and code
    ("""<html><body><div class="topbar"><a href=/>Docs</a><form role=search><input placeholder=Search></form></div><div class="layout"><div class="toc"><ul><li><a href=#i>Install</a></li><li><a href=#u>Use</a></li></ul></div><section class="body"><h1>Query cache</h1><p>The cache keeps the rows of recent queries in memory. It is off by default.</p><h2 id=i>Install</h2><p>Add the module to the list in the settings file, then restart.</p><pre>modules = cache, log
cache.size = 64</pre><h2 id=u>Use</h2><p>No query needs a change. Writes to a table drop its rows from the cache.</p><table><tr><th>Setting</th><th>Meaning</th></tr><tr><td>cache.size</td><td>megabytes kept</td></tr></table></section></div><div class="pager"><a href=p>Previous</a> <a href=n>Next</a></div><div class="footer">Built 2024. <a href=/e>Edit this page</a></div></body></html>""",
     ["Query cache", "The cache keeps the rows of recent queries in memory. It is off by default.", "Install", "Add the module to the list in the settings file, then restart.", "modules = cache, log cache.size = 64", "Use", "No query needs a change. Writes to a table drop its rows from the cache.", "Setting", "Meaning", "cache.size", "megabytes kept"]),
]
# fmt: on
