"""What counts as fashion. Fixed values."""

FASHION = ("tops", "pants", "jeans", "shorts", "skirts", "dresses", "knitwear", "outerwear", "lingerie", "swimwear", "activewear", "shoes", "bags", "jewelry", "accessories")
OTHER = (
    r"(?iuU)\b("
    r"sabanas?|sábanas?|acolchado|cubrecama|almohadon|almohadón|almohada|toallon|toallón|toallas?|manteles?|cortinas?|repasador|frazada|colcha|funda de (?:almohada|sillon|sillón)|alfombra|"
    r"termo|mate|bombilla|vajilla|tupper|taza|vaso|jarra|olla|sarten|sartén|cubiertos|bandeja|organizador|percha|perchas|"
    r"auricular|auriculares|cargador|cable|parlante|bluetooth|led|foco|celular|smartwatch|power ?bank|usb|adaptador|control remoto|velador|"
    r"maquillaje|delineador|labial|perfume|sombra|rimel|rímel|esmalte|shampoo|acondicionador|crema (?:facial|corporal|de manos)|serum|mascarilla|pestañas|cosmetic|brillo labial|"
    r"base liquida|base líquida|polvo (?:compacto|translucido|traslúcido)|corrector|rubor|"
    r"cuaderno|lapicera|marcador|juguete|peluche|munieco|muñeco|puzzle|herramienta|destornillador|linterna|pila|pilas|"
    r"planta artificial|maceta|adorno|cuadro decorativo|velas?|sahumerio"
    r")\b"
)
MALL_OTHER = (
    r"(?iu)gastronom|food|dining|servicio|service|est[eé]tica|beauty|farmac|tecno|electro|electronic|entreten|entertainment|cine|banco|supermerc|juguete|librer|home|deco|mascota|[óo]ptica|salud"
)
MALL_FASHION = r"(?iu)mujer|hombre|women|men|calzado|footwear|accesorio|accessor|deporte|sport|beb[eé]s|babies|kids|ni[nñ]os|indumentaria|ropa|moda"
