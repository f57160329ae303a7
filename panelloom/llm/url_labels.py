"""A small labelled URL table, written by hand for the URL filter: one URL a line, unwanted and ordinary ones, and
as many again put together from words that names of such sites hold.

Names are made up from words that such sites use, under top-level domains that are reserved for tests, so no
URL of a crawl is in it. ``held_out`` parts the table by host, for measuring the filter on hosts it has not seen.
"""

from __future__ import annotations

import re
import zlib

UNWANTED = """
https://www.royal-slots-casino.test/play/now
http://bonus.online-casino-king.example/en/free-spins
https://poker-jackpot-room.test/signup?bonus=200
http://www.lucky-roulette.example/de/spielen.html
https://bet-on-sports-today.test/odds/live
http://grand-bingo-bonus.example/fr/jeu
https://win-big-lottery.test/claim-prize
http://free-slots-spins.example/games/777.html
https://casino-roulette-bonus.test/es/jugar
http://mega-jackpot-winner.example/prize?id=5
https://www.discount-pharmacy-pills.test/order/viagra
http://generic-cialis-online.example/buy-cheap
https://cheapest-meds-rx.test/en/no-prescription
http://weight-loss-pills-now.example/diet/miracle
https://buy-steroids-fast.test/shop/cart
http://pharma-pill-store.example/de/bestellen
https://order-tramadol-cheap.test/checkout
http://male-enhancement-pill.example/offer.html
https://canadian-pill-mart.test/fr/acheter
http://slimming-tea-miracle.example/buy
https://www.hot-xxx-videos.test/watch/1
http://adult-cams-live.example/chat
https://free-porn-tube.test/en/video/77
http://sexy-singles-dating.example/join
https://nude-pics-gallery.test/album/3
http://escort-girls-city.example/es/chicas
https://xxx-adult-webcam.test/models
http://hookup-tonight-adult.example/de/treffen
https://instant-payday-loans.test/apply
http://fast-cash-no-credit.example/loan/now
https://bad-credit-loans-cheap.test/en/rates
http://quick-money-home.example/earn/500-a-day
https://make-money-fast-online.test/secret
http://forex-profit-robot.example/signal
https://double-your-bitcoin.test/invest
http://crypto-profit-bot.example/join?ref=88
https://earn-cash-clicking.test/start
http://debt-relief-instant.example/fr/credit
https://replica-watches-outlet.test/rolex
http://fake-designer-bags.example/sale/gucci
https://cheap-jerseys-outlet.test/en/nfl
http://replica-shoes-discount.example/buy
https://luxury-replica-shop.test/de/uhren
http://cheap-sunglasses-sale.example/ray
https://outlet-bags-cheap.test/es/bolsos
http://discount-brand-outlet.example/shop.html
https://best-link-exchange.test/seo/backlinks
http://seo-backlinks-cheap.example/buy-links
https://link-directory-spam.test/add-url
http://guest-post-links.example/farm/12
https://article-spinner-seo.test/content
http://free-backlinks-farm.example/en/list
https://submit-links-free.test/directory/all
http://keyword-spam-pages.example/de/seite
https://doorway-pages-seo.test/k/insurance
http://link-wheel-spam.example/index2.html
https://ads.click-tracker.test/click?id=1
http://track.pixel-ads-server.example/imp.gif
https://adserver.popup-network.test/show
http://banner-ads-exchange.example/serve/44
https://clicks.affiliate-track.test/redirect?to=x
http://popunder-traffic-ads.example/pop.js
https://tracker.ad-clicks.test/pixel/9
http://sponsored-ads-track.example/fr/clic
https://traffic-exchange-hits.test/surf
http://ad-redirect-track.example/go?u=3
https://free-iphone-winner.test/claim
http://survey-gift-cards.example/win/card
https://you-have-won-prize.test/en/collect
http://virus-alert-download.example/fix-now.exe
https://free-ringtones-download.test/mobile
http://cracked-software-keygen.example/serial
https://warez-torrent-cracks.test/download/all
http://movie-stream-free-hd.example/watch-now
https://password-crack-tools.test/hack
http://flash-player-update-now.example/install.exe
https://psychic-love-spells.test/reading
http://essay-writing-cheap.example/order
https://buy-followers-likes.test/instagram
http://cheap-hosting-spam.example/offer/1
https://miracle-cure-secret.test/doctors-hate
http://wrinkle-cream-trial.example/free-trial
https://buy-fake-diploma.test/en/degree
http://email-blast-spam.example/lists/10m
https://mass-mailer-spam.test/download
http://spam-comment-bot.example/tool.html
""".split()

ORDINARY = """
https://www.morning-herald.test/world/2023/05/election-results.html
http://news.harbor-times.example/en/local/council-meeting
https://daily-courier.test/sport/match-report
http://www.evening-post.example/opinion/letters
https://valley-tribune.test/de/politik/bericht.html
http://press.northern-gazette.example/fr/culture
https://observer.test/2021/11/interview
http://weekly-review.example/es/economia/mercado
https://www.river-city-radio.test/programs/morning
http://capital-journal.example/business/markets
https://docs.query-engine.test/guide/install.html
http://developer.open-maps.example/api/reference
https://wiki.linux-users.test/article/filesystem
http://manual.image-editor.example/en/layers
https://code.data-tools.test/project/issues/42
http://forum.python-learners.example/thread/118
https://support.printer-drivers.test/faq
http://blog.compiler-notes.example/2020/03/parsing
https://packages.stat-library.test/docs/index
http://help.spreadsheet.example/fr/formules
https://www.state-university.test/courses/biology
http://math.college.example/~smith/lectures/notes.html
https://library.university-press.test/catalog/item/9312
http://school-district.example/calendar
https://open-lectures.test/en/physics/unit-3
http://journal-of-history.example/volume/12/paper
https://archive.science-review.test/article/5521
http://research-institute.example/de/publikationen
https://encyclopedia.test/entry/photosynthesis
http://dictionary.example/es/palabra/camino
https://www.city-museum.test/exhibitions/impressionists
http://national-gallery.example/collection/painting/88
https://opera-house.test/season/program
http://theatre.example/fr/spectacle/moliere
https://botanical-garden.test/visit/hours
http://zoo.example/animals/otter
https://heritage-trust.test/en/castles/map
http://film-archive.example/de/filme/1927
https://chamber-music.test/concerts
http://poetry-foundation.example/poem/autumn
https://www.county-council.test/services/recycling
http://health-ministry.example/en/vaccination
https://parliament.test/bills/2022/14
http://tax-office.example/forms/1040.html
https://statistics-bureau.test/tables/population
http://weather-service.example/forecast/coast
https://city-transit.test/routes/line-4
http://national-park.example/trails/map
https://fire-department.test/safety/smoke
http://court-records.example/es/sentencias
https://hospital.test/departments/cardiology
http://clinic-notes.example/patients/diabetes
https://nutrition-guide.test/article/vitamins
http://nursing-journal.example/fr/soins
https://family-doctor.test/de/grippe
http://running-club.example/training/marathon
https://recipes.home-kitchen.test/soup/lentil
http://baking-diary.example/2019/sourdough
https://garden-planner.test/en/tomatoes
http://carpentry-workshop.example/projects/shelf
https://knitting-patterns.test/pattern/scarf
http://bird-watching.example/species/robin
https://hiking-stories.test/de/alpen/tour.html
http://travel-diary.example/fr/bretagne/jour-3
https://photo-walks.test/gallery/lighthouse
http://chess-club.example/games/annotated
https://football-league.test/table/2024
http://cycling-routes.example/es/ruta/sierra
https://sailing-school.test/lessons
http://tennis-results.example/final
https://bookshop.test/authors/woolf
http://publishing-house.example/catalogue/spring
https://reading-group.test/review/novel
http://comics-archive.example/strip/1201
https://language-school.test/en/grammar/verbs
http://translation-notes.example/de/glossar
https://history-blog.test/medieval/trade
http://genealogy.example/family/miller
https://archaeology.test/site/roman-villa
http://philosophy-cafe.example/fr/essai/liberte
https://bakery.test/menu
http://hotel-bellevue.example/rooms
https://bicycle-repair.test/contact
http://architects.example/projects/school
https://furniture-makers.test/chairs/oak
http://law-office.example/team
https://dental-practice.test/appointments
http://vineyard.example/es/bodega/visita
https://camera-reviews.test/lens/50mm
http://car-magazine.example/test/estate
https://real-estate.test/listing/338
http://farm-market.example/vegetables
https://energy-cooperative.test/de/strom
http://water-utility.example/bill/explained
https://insurance-advice.test/home/flood
http://bank.example/accounts/savings
https://engineering-society.test/standards/bridges
http://chemistry-lab.example/experiments/7
https://astronomy-club.test/observing/saturn
http://geology.example/fr/roches
https://m.town-portal.test/events#today
http://intranet.example/index.html?page=2
https://thurston.example/about
http://erlington.test/en/142
https://m.aldington.example/es/77.html
http://blog.onshire.test/de/5/
https://www.renthall.example/fr/913?utm_source=feed
http://annerley.test/en/604#top
""".split()

#: Words that names of such sites are put together from, by subject.
UNWANTED_WORDS = """
casino slots poker roulette jackpot betting bingo bonus
pills pharmacy meds viagra cialis diet rx discount
adult xxx porn cams sexy escort dating nude
loans payday cash money credit profit forex rich
replica outlet cheap sale bags watches fake brands
seo backlinks links spam farm traffic directory keyword
ads click tracker popup banner redirect affiliate pixel
free winner prize survey gift claim lottery win
warez torrent crack keygen hack serial exe download
"""
ORDINARY_WORDS = """
news herald times courier gazette journal press tribune
docs guide manual api code developer forum wiki
university college school library lecture research science institute
museum gallery theatre opera music film art heritage
council ministry parliament court transit police weather park
hospital clinic health nursing doctor dental nutrition care
recipes kitchen garden baking farm market bakery wine
travel hiking hotel sailing cycling running tennis football
books reading poetry history language dictionary archive publishing
house furniture repair architects engineering energy water bank
hill brook ford field wood dale bridge port
alton marsh weston carver linden hobart delmar quincy
sato kimura rossi moretti dubois laurent schmidt keller
novak horvat jensen olsen silva costa moreno vega
thornton atherton northam enderby renshaw ashworth tilden overton
"""


def _put_together(words: str, label: int) -> list[tuple[str, int]]:
    out = []
    for line in words.split("\n"):
        names = line.split()
        for k, a in enumerate(names):
            for step in (1, 3):
                b, n = names[(k + step) % len(names)], len(out)
                link = ("-", "")[n % 2]
                tail = ("", f"en/{7 * n + 2}/", f"de/{5 * n + 1}.html", f"fr/{n}", f"es/{3 * n}?x=1", f"en/{n}#top", "index.html")[n % 7]
                out.append((f"http{'s' * (n % 2)}://{('', 'www.', 'm.', 'blog.')[n % 4]}{a}{link}{b}.{('test', 'example')[n // 2 % 2]}/{tail}", label))
    return out


LABELLED = [(u, 1) for u in UNWANTED] + [(u, 0) for u in ORDINARY] + _put_together(UNWANTED_WORDS, 1) + _put_together(ORDINARY_WORDS, 0)


def host(url: str) -> str:
    return re.match(r".*?://([^/?#]*)", url)[1]


def held_out(url: str, parts: int = 4) -> bool:
    """Whether a URL's host is among the ``parts``-th of hosts kept for measuring."""
    return zlib.crc32(host(url).encode()) % parts == 0
