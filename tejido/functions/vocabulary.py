"""Words that questions are read with. Fixed values, in the order in which they are tried."""

from __future__ import annotations

CATEGORY_WORDS = {
    "dresses": ("vestido", "vestidos"),
    "jeans": ("jean", "jeans", "denim"),
    "pants": ("pantalon", "pantalón", "pantalones", "cargo", "calza"),
    "skirts": ("pollera", "polleras", "falda"),
    "shorts": ("short", "shorts", "bermuda"),
    "tops": ("top", "tops", "remera", "remeras", "camisa", "blusa", "musculosa", "chomba"),
    "knitwear": ("sweater", "buzo", "buzos", "cardigan", "hoodie"),
    "outerwear": ("campera", "camperas", "abrigo", "tapado", "saco", "blazer"),
    "shoes": ("zapatilla", "zapatillas", "zapato", "bota", "botas", "sandalia"),
    "bags": ("cartera", "bolso", "mochila"),
    "jewelry": ("collar", "anillo", "aros", "pulsera"),
    "lingerie": ("lenceria", "lencería", "corpiño", "bombacha", "pijama"),
    "swimwear": ("bikini", "malla", "mallas"),
}
FABRIC_AND_CATEGORY = ("jean", "jeans", "denim")
COLOR_WORDS = {
    "black": ("negro", "negra", "negros", "grafito", "antracita"),
    "white": ("blanco", "blanca", "off white", "hueso", "marfil", "tiza"),
    "blue": ("azul", "celeste", "navy", "turquesa", "petroleo", "petróleo"),
    "red": ("rojo", "roja", "bordo", "bordó", "borgoña", "borgona", "vino", "ladrillo", "coral", "salmon", "salmón"),
    "green": ("verde", "oliva", "menta"),
    "pink": ("rosa", "rosado", "fucsia"),
    "beige": ("beige", "nude", "camel", "crudo", "arena", "tostado"),
    "brown": ("marron", "marrón", "chocolate", "terracota", "ocre", "cobre"),
    "grey": ("gris", "plomo"),
    "yellow": ("amarillo", "mostaza", "dorado"),
    "purple": ("violeta", "lila", "lavanda", "malva"),
}
AXES = {
    "tela": {
        "morley": ("morley",), "frisa": ("frisa", "frisado"), "bengalina": ("bengalina",), "microfibra": ("microfibra",), "gabardina": ("gabardina",), "lino": ("lino",),
        "algodón": ("algodon", "algodón"), "seda": ("seda",), "encaje": ("encaje", "puntilla"), "tul": ("tul",), "cuero": ("cuero", "ecocuero"), "denim": ("denim", "jean"),
        "lana": ("lana", "lanilla"), "viscosa": ("viscosa", "modal"), "lycra": ("lycra", "elastizad"), "rústico": ("rustico", "rústico"), "satén": ("saten", "satén", "satinad"), "corderoy": ("corderoy", "pana"),
    },
    "silueta": {
        "oversize": ("oversize", "amplio", "holgad"), "entallado": ("entallad", "al cuerpo", "ajustad", "slim"), "wide leg": ("wide leg", "palazzo", "pierna ancha"), "recto": ("recto", "straight"),
        "tiro alto": ("tiro alto",), "tiro medio": ("tiro medio",), "cropped": ("crop", "corto"), "largo": ("largo", "maxi"), "midi": ("midi",), "mini": ("mini",),
        "babucha": ("babucha", "jogger"), "mom fit": ("mom fit", "mom "),
    },
    "detalle": {
        "con capucha": ("capucha", "hoodie"), "sin mangas": ("sin manga", "musculosa"), "manga larga": ("manga larga",), "escote v": ("escote v", "cuello v"), "estampado": ("estampad", "print", "floral"),
        "liso": ("liso",), "tajo": ("tajo",), "volados": ("volado", "volante"), "bordado": ("bordad",), "con brillo": ("brillo", "lentejuela", "glitter"),
    },
}
UPTO = r"(?iu)(?:menos de|hasta|bajo|máx(?:imo)?|max|no más de)\s*\$?\s*([\d.,]+)\s*(lucas|mil|k)?"
FROM = r"(?iu)(?:más de|desde|mín(?:imo)?|min|arriba de)\s*\$?\s*([\d.,]+)\s*(lucas|mil|k)?"
BETWEEN = r"(?iu)entre\s*\$?\s*([\d.,]+)\s*(?:y|a)\s*\$?\s*([\d.,]+)"
SIZE = r"(?iuU)\btalles?\s*([0-9]{1,2}|xxs|xs|s|m|l|xl|xxl)\b"
GENDER_PATTERNS = {"men": r"(?iuU)\b(hombre|masculino|caballero|men)s?\b", "women": r"(?iuU)\b(mujer|femenino|dama|women)s?\b", "kids": r"(?iuU)\b(ni[nñ]o|ni[nñ]a|beb[eé]|kids|infantil)s?\b"}
WHOLESALE_WORDS = ("mayorista", "avellaneda", "por mayor")
WHOLESALE_STORE = "avellaneda"
