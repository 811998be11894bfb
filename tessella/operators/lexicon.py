"""Word lists and patterns of printed labels."""

from __future__ import annotations


def _items(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", " ").split(",") if x.strip()]


# ---- Fixed values: results follow from exactly these ----------------------------------------------------------------

#: Grapes in order, with the colour that they give.
GRAPES = [
    ("Red", """
    Cabernet Sauvignon, Cabernet Franc, Merlot, Pinot Noir, Syrah, Shiraz, Grenache, Garnacha, Mourvèdre,
    Monastrell, Carignan, Cariñena, Cinsault, Malbec, Petit Verdot, Tannat, Zinfandel, Primitivo, Sangiovese,
    Nebbiolo, Barbera, Dolcetto, Corvina, Rondinella, Molinara, Montepulciano, Aglianico, Nero d'Avola,
    Negroamaro, Lambrusco, Tempranillo, Mencía, Bobal, Touriga Nacional, Touriga Franca, Tinta Roriz, Baga,
    Pinotage, Carmenère, Gamay, Blaufränkisch, Zweigelt, Saperavi, Xinomavro, Agiorgitiko, Plavac Mali,
    Refosco, Schiava, Teroldego, Lagrein, Sagrantino, Cannonau, Frappato, Bonarda, Trousseau, Poulsard,
    Mondeuse, Counoise, Alicante Bouschet, Graciano, Mazuelo, Castelão, Trincadeira, Alfrocheiro"""),
    ("White", """
    Chardonnay, Sauvignon Blanc, Riesling, Pinot Gris, Pinot Grigio, Pinot Blanc, Gewürztraminer, Muscat,
    Moscato, Viognier, Marsanne, Roussanne, Chenin Blanc, Sémillon, Albariño, Alvarinho, Verdejo, Godello,
    Viura, Macabeo, Xarel·lo, Parellada, Grüner Veltliner, Silvaner, Müller-Thurgau, Vermentino, Trebbiano,
    Garganega, Falanghina, Fiano, Greco, Verdicchio, Cortese, Arneis, Ribolla Gialla, Friulano, Malvasia,
    Assyrtiko, Moschofilero, Furmint, Rkatsiteli, Torrontés, Khikhvi, Chinuri, Kisi, Mtsvane, Kakhuri Mtsvane,
    Goruli Mtsvane, Tsolikouri, Tsitska, Krakhuna"""),
    ("Red", "Aladasturi, Ojaleshi, Tavkveri, Shavkapito, Otskhanuri Sapere, Usakhelouri, Alexandrouli, Mujuretuli, Chkhaveri"),
    ("White", """
    Colombard, Melon de Bourgogne, Picpoul, Clairette, Bourboulenc, Aligoté, Savagnin, Petite Arvine, Koshu,
    Grillo, Catarratto, Carricante, Pecorino, Vernaccia, Scheurebe, Kerner, Chasselas, Loureiro, Arinto,
    Encruzado, Antão Vaz"""),
]

#: Countries by the name to record: how labels print them.
COUNTRIES = {
    "France": ["France"], "Italy": ["Italy", "Italia"], "Spain": ["Spain", "España", "Espana"], "Portugal": ["Portugal"],
    "Germany": ["Germany", "Deutschland"], "Austria": ["Austria", "Österreich"], "Australia": ["Australia"],
    "New Zealand": ["New Zealand"], "South Africa": ["South Africa"], "Argentina": ["Argentina"], "Chile": ["Chile"],
    "USA": ["United States", "USA", "California"], "Greece": ["Greece"], "Mexico": ["Baja California", "Mexico", "México"],
    "Hungary": ["Hungary"], "Romania": ["Romania"], "Georgia": ["Georgia"], "Switzerland": ["Switzerland", "Suisse"],
    "Lebanon": ["Lebanon"], "Israel": ["Israel"], "Uruguay": ["Uruguay"], "Brazil": ["Brazil"], "Canada": ["Canada"],
    "England": ["England"], "Slovenia": ["Slovenia"], "Croatia": ["Croatia"], "Japan": ["Japan"],
}

#: Types, the first that fits first: words that name them.
TYPE_WORDS = {
    "Sparkling": _items("sparkling, spumante, cremant, champagne, cava, sekt, prosecco, franciacorta, metodo classico, methode traditionnelle, blanc de blancs, blanc de noirs, brut, extra dry, pet nat"),
    "Fortified": _items("porto, port wine, sherry, jerez, madeira, marsala, vin doux naturel, oloroso, amontillado, fino, manzanilla, pedro ximenez, tawny, ruby"),
    "Dessert": _items("sauternes, moelleux, passito, late harvest, vendanges tardives, beerenauslese, trockenbeerenauslese, eiswein, ice wine, dolce, selection de grains nobles, vin de paille, recioto"),
    "Amber": _items("amber wine, orange wine, qvevri amber, amber"),
    "Rosé": _items("rose wine, vin rose, rosato, rosado, rosé, rose"),
    "White": _items("white wine, vino bianco, vin blanc, vino blanco, weisswein, vinho branco, bianco, blanc, blanco, branco, weiss"),
    "Red": _items("red wine, vino rosso, vin rouge, vino tinto, rotwein, vinho tinto, rosso, rouge, tinto, tinta, rot"),
}

#: Packaging boilerplate.
NOISE_PATTERNS = [
    r"\b\d{1,2}[.,]?\d*\s*%\s*(vol|alc)", r"\balc(ohol)?\b.*\bvol\b", r"\b\d{2,4}\s?(ml|cl|l)\b", r"\bcontains?\s+sulfites?\b",
    r"\bsulphites?\b", r"\bgovernment\s+warning\b", r"\bsurgeon\s+general\b", r"\bimported\s+by\b", r"\bdistributed\s+by\b",
    r"\bproduct\s+of\b", r"\bproduce\s+of\b", r"\bproduced\s+(in|by)\b", r"^(est|estd|established|since|founded)\.?(\s+\d{4})?$",
    r"^(contr[oô]l[ée]e|prot[ée]g[ée]e)$", r"\bmis\s+en\s+bouteille\b", r"\bestate\s+bottled\b", r"\bbottled\s+by\b", r"\bimbottigliato\b",
    r"\bembotellado\b", r"\berzeugerabf(ü|u)llung\b", r"\bgrand\s+vin\b", r"\bvin\s+de\s+france\b", r"\bappellation\b.*\b(contr[oô]l[ée]e|prot[ée]g[ée]e)\b",
    r"\bdenominazione\s+di\s+origine\b", r"\bdenominaci[oó]n\s+de\s+origen\b", r"\bwine\s+of\s+origin\b", r"^\d{6,}$", r"^[\d\s.,%-]+$",
    r"\b750\s*m\b", r"\balc\b", r"\bvol\b", r"\b(iwsc|decanter|mundus\s+vini|concours|trophy|medal|medaille|médaille|points)\b",
    r"\b(cru\s+bourgeois|grand\s+cru|premier\s+cru|1er\s+cru|cru\s+class[ée]|class[ée]\s+de\s+graves)\b",
    r"\b(vieilles\s+vignes|old\s+vines|vecchie\s+vigne|vi[ñn]as\s+viejas)\b", r"\b(vino|vin|vinho)\s+(biologico|bio|org[aá]nico|biol[oó]gico)\b",
]
#: Boilerplate looked for with some letters wrong, as phrases and as long words in text without spaces.
NOISE_PHRASES = _items("mis en bouteille, contains sulfites, contains sulphites, product of, produce of, estate bottled, grand vin, government warning, imported by, wine of origin, denominazione di origine, denominacion de origen")
NOISE_WORDS = _items("indicazione, geografica, denominazione, controllata, garantita, appellation, controlee, protegee, imbottigliato, embotellado, produced, bottled, sulfites, sulphites, contains, biologico")

#: Words in front of and behind a producer's name; words that may stand between the latter.
PRODUCER_PREFIXES = _items("château, chateau, domaine, domaines, bodega, bodegas, weingut, tenuta, tenute, quinta, cantina, cantine, azienda agricola, azienda, podere, poderi, castello, viña, vina, viñedos, marqués de, marques de, maison, fattoria, masseria, herdade, schloss, clos, famille, família, familia, cave, caves, champagne, casa, ca', weinhaus, weingärtner, winzer")
PRODUCER_SUFFIXES = _items("winery, wineries, vineyards, vineyard, cellars, cellar, estate, estates, wines, wine co, brothers, family wines")
TAIL_GLUE = _items("and, e, y, et, de, di, del, della, the")

#: What tells a single vineyard; the name is the group.
VINEYARD_PATTERNS = [r"\bvigneto\s+(.+)$", r"\bvigna\s+(.+)$", r"\bvi[ñn]edo\s+(.+)$", r"^(.+?)\s+vineyard$", r"\bsingle\s+vineyard\s+(.+)$"]
#: Words before a year that isn't the vintage.
FOUNDING_WORDS = _items("est, estd, established, since, founded, fondee, fondata, fundada, gegrundet, anno, depuis, dal, desde, seit, aoc")
#: Words that describe a bottle and name none.
DESCRIPTORS = _items("""
    dry, sweet, semi, medium, off, extra, still, natural, organic, biodynamic, unfiltered, unfined, vegan, table, quality, premium,
    classic, traditional, fine, old, vines, pale, light, soft, late, harvest, reserva, riserva, reserve, gran, crianza, joven, solera,
    fino, oloroso, amontillado, manzanilla, cream, bio, biologico, organico, ecologico, sherry, vendemmia, vendange, vintage, nature,
    cuvee, white, red, rose, amber, orange, pink, wine, wines, vino, vin, vinho, wein, vini, vins, qvevri, kvevri, sparkling, brut, sec,
    demi, doux, blanc, blanche, rouge, rosso, bianco, tinto, blanco, rosado, rosato, georgian, french, italian, spanish, german,
    portuguese, greek, of, de, di, du, and, e, y, the, a
""")
MARKETING_PATTERNS = [
    r"^(limited|special|numbered|anniversary|collectors?'?s?)\s+(edition|release)$", r"^(family|estate)\s+(owned|grown|run)$",
    r"^hand\s*(picked|crafted|harvested|made)$", r"^small\s+batch$", r"^(vegan|organic|natural)\s+(wine|friendly)$",
]
PROSE_WORDS = _items("and, was, is, are, were, this, with, from, our, has, have, that, which, its, it, we, you, your, been, into, on")
STOPWORDS = _items("""
    the, a, an, and, of, in, on, with, from, by, to, for, at, is, was, le, la, les, des, du, de, et, un, une, est, sur, dans, avec, pour,
    il, lo, gli, di, del, della, e, con, per, da, el, los, las, y, para, por, der, die, das, und, mit, von, aus, im
""")
#: Grape look-alikes that are names; stray words that name nobody; what opens a cuvée's name; what announces an appellation.
LOOKALIKES = ["mellot"]
STRAY_WORDS = _items("vol, ml, cl, alc, abv, au, de, du, la, le, el")
CUVEE_PREFIX = r"^(cuv[ée]e|selecci[oó]n|selezione|reserva|riserva|gran reserva|bin\s+\d+|n[o°º]\s*\d+)\b"
APPELLATION_MARKER = r"\b(appellation|denominazione|denominaci[oó]n|wine of origin|DOCG|DOCa|DOC|DOP|AOC|AOP|IGP|IGT|AVA)\b"
DECLARED_FRENCH = r"appellation\s+(.+?)\s+(?:contr[oôóò]l[ée]{1,2}e?|prot[ée]g[ée]e)\b"
DECLARED_SHORT = r"^(.*?)\s*\b(?:DOCG|DOCa|DOC|DOP?|AOC|AOP|IGP|IGT|AVA)\b"

#: Places in order, with the country and region that they imply. The part of the table that labels need most; label_fields takes a
#: full one as its parameter (sources.read_places).
PLACES = [
    ("Georgia", "Kakheti", "Mukuzani, Kindzmarauli, Tsinandali, Napareuli, Manavi, Akhasheni, Kvareli, Teliani, Gurjaani, Kotekhi, Kardenakhi, Tibaani, Vazisubani, Khashmi"),
    ("Georgia", "Racha-Lechkhumi", "Khvanchkara, Tvishi"), ("Georgia", "Imereti", "Sviri"), ("Georgia", "Kartli", "Ateni, Bolnisi"),
    ("Georgia", "Kakheti", "Kakheti"), ("Georgia", "Kartli", "Kartli"), ("Georgia", "Imereti", "Imereti"),
    ("France", "Bordeaux", "Margaux, Pauillac, Saint-Julien, Saint-Estèphe, Pessac-Léognan, Graves, Saint-Émilion, Pomerol, Fronsac, Sauternes, Barsac, Haut-Médoc, Médoc, Listrac-Médoc, Moulis-en-Médoc, Bordeaux Supérieur, Bordeaux"),
    ("France", "Bourgogne", """Chablis, Meursault, Puligny-Montrachet, Chassagne-Montrachet, Gevrey-Chambertin, Nuits-Saint-Georges, Vosne-Romanée,
    Chambolle-Musigny, Morey-Saint-Denis, Pommard, Volnay, Savigny-lès-Beaune, Aloxe-Corton, Corton-Charlemagne, Montrachet, Chambertin, Musigny,
    Pouilly-Fuissé, Saint-Véran, Mercurey, Rully, Givry, Montagny, Mâcon-Villages, Mâcon, Beaune, Bourgogne"""),
    ("France", "Beaujolais", "Moulin-à-Vent, Brouilly, Morgon, Fleurie, Beaujolais"),
    ("France", "Rhône", "Châteauneuf-du-Pape, Côtes du Rhône, Gigondas, Vacqueyras, Rasteau, Cairanne, Lirac, Tavel, Crozes-Hermitage, Hermitage, Cornas, Saint-Joseph, Côte-Rôtie, Condrieu"),
    ("France", "Loire", "Sancerre, Pouilly-Fumé, Vouvray, Chinon, Bourgueil, Saumur-Champigny, Saumur, Savennières, Muscadet"),
    ("France", "Champagne", "Champagne"), ("France", "Alsace", "Alsace"), ("France", "Provence", "Bandol, Côtes de Provence"),
    ("France", "Languedoc", "Corbières, Minervois"), ("France", "Sud-Ouest", "Cahors, Madiran"),
    ("Italy", "Piemonte", "Barolo, Barbaresco, Barbera d'Alba, Barbera d'Asti, Dolcetto d'Alba, Langhe, Roero, Gavi, Moscato d'Asti, Asti"),
    ("Italy", "Lombardia", "Franciacorta, Valtellina"), ("Italy", "Veneto", "Amarone della Valpolicella, Valpolicella Ripasso, Valpolicella, Soave, Bardolino, Prosecco, Lugana"),
    ("Italy", "Trentino-Alto Adige", "Alto Adige"),
    ("Italy", "Toscana", "Chianti Classico, Chianti, Brunello di Montalcino, Rosso di Montalcino, Vino Nobile di Montepulciano, Bolgheri, Maremma"),
    ("Italy", "Puglia", "Primitivo di Manduria, Salice Salentino"), ("Italy", "Sicilia", "Etna, Marsala"),
    ("Spain", "Rioja", "Rioja"), ("Spain", "Castilla y León", "Ribera del Duero, Rueda, Toro, Bierzo"),
    ("Spain", "Catalunya", "Priorat, Montsant, Penedès, Cava"), ("Spain", "Galicia", "Rías Baixas"), ("Spain", "Andalucía", "Jerez"),
    ("Spain", "Murcia", "Jumilla"), ("Spain", "Navarra", "Navarra"),
    ("Portugal", "Douro", "Douro, Porto"), ("Portugal", "Dão", "Dão"), ("Portugal", "Minho", "Vinho Verde"), ("Portugal", "Alentejo", "Alentejo"),
    ("Germany", "Mosel", "Mosel"), ("Germany", "Rheingau", "Rheingau"), ("Germany", "Rheinhessen", "Rheinhessen"), ("Germany", "Pfalz", "Pfalz"),
    ("Austria", "Niederösterreich", "Wachau, Kremstal, Kamptal"), ("Austria", "Burgenland", "Burgenland"),
    ("USA", "California", "Napa Valley, Sonoma Coast, Russian River Valley, Alexander Valley, Oakville, Paso Robles, Carneros, Lodi"),
    ("USA", "Oregon", "Willamette Valley"), ("USA", "Washington", "Columbia Valley"), ("New Zealand", "Marlborough", "Marlborough"),
    ("New Zealand", "Central Otago", "Central Otago"), ("Australia", "South Australia", "Barossa Valley, McLaren Vale, Coonawarra"),
    ("Australia", "Victoria", "Yarra Valley"), ("Australia", "Western Australia", "Margaret River"), ("South Africa", "Western Cape", "Stellenbosch, Swartland"),
    ("Argentina", "Mendoza", "Uco Valley, Mendoza"), ("Chile", "Valle de Colchagua", "Colchagua"), ("Hungary", "Tokaj", "Tokaj"), ("Greece", "Santorini", "Santorini"),
    ("USA", "California", "Sonoma County, Sonoma"), ("Mexico", "Baja California", "Valle de Guadalupe"), ("Italy", "Puglia", "Tarantino, Salento"),
]

# ---- End of the fixed values ----------------------------------------------------------------------------------------

#: A word's edge as ASCII letters, digits and _ make it, on either side.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def pattern(text: str) -> str:
    """For Spark: any case, also beyond ASCII; Unicode white space; ASCII digits; the edge above."""
    return "(?iu)" + text.replace(r"\b", EDGE).replace("\\s", r"[\s\u0085\p{Z}\uFEFF]")


def grapes() -> list[tuple[str, str]]:
    return [(g, colour) for colour, names in GRAPES for g in _items(names)]


def countries() -> list[tuple[str, str]]:
    return [(printed, name) for name, many in COUNTRIES.items() for printed in many]


def places() -> list[tuple[str, str, str]]:
    return [(name, country, region) for country, region, names in PLACES for name in _items(names)]
