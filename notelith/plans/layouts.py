"""The layouts of suppliers' delivery notes, as data.

Fixed values: names of suppliers, the words of their tables' heads and the warnings that their rows carry.
"""

from __future__ import annotations

from notelith.operators.extraction import Layout

_DIGITS3, _DIGITS5, _DIGITS6 = "[0-9]{3,}[A-Z0-9./-]*", "[0-9]{5,}", "[0-9]{6}"

LAYOUTS = [
    Layout("GENERIC", "generic", warning="GENERIC_PARSER_USED"),
    Layout("A2ZWORLD", "page"),
    Layout("ADARRA", min_numbers=3, warning="adarra_multiline_rescue"),
    Layout("AELVASA", head=("REFERENCIA", "MARCA", "CONCEPTO", "IMPORTE"), min_numbers=3, orders={5: ["quantity", "price", "fee", "discount", "amount"]}),
    Layout("ALKAIN", head=("ART", "DESCRIP", "CANT", "PRECIO"), min_numbers=2),
    Layout("ARAIZ", head=("CANTIDAD", "PRECIO"), min_numbers=2),
    Layout("ARTESOLAR", head=("REFERENCIA", "CONCEPTOS", "CANTIDAD"), warning="artesolar_structured"),
    Layout("AUTOMATION24", warning="automation24_structured"),
    Layout("AXOR", head=("ART", "CONCEPTO", "CAN", "IMPORTE"), warning="axor_no_importe_visible"),
    Layout("BACOLSA", head=("REFERENCIA", "DESCRIPCION", "CANTIDAD"), warning="bacolsa_structured"),
    Layout("BALANTXA", "page", head=("FECHA", "CONCEPTO", "IMPORTE"), warning="balantxa_structured"),
    Layout("BASMODEC", head=("ARTICULO", "DESCRIPCION"), min_numbers=3),
    Layout("BERDIN", head=("CODIGO", "DESCRIPCION", "SERVIDA", "PRECIO", "IMPORTE"), stop=("TOTAL", r"\*\*\*"), min_numbers=2),
    Layout("CARANDINI", code=_DIGITS6, warning="carandini_structured"),
    Layout("CLC", head=("DENOMIN", "CANTIDAD"), min_numbers=3),
    Layout("DATAERASER", "page", warning="dataeraser_structured"),
    Layout("Efecto Led", head=("REFERENCIA", "DESCRIPCION", "CANTIDAD"), warning="efecto_led_structured"),
    Layout("ELEKTRA", head=("ARTICULO", "CONCEPTO", "CANTIDAD", "IMPORTE"), code=_DIGITS3, min_numbers=3),
    Layout("ELICETXE", head=("MARCA", "REFER")),
    Layout("ELT", head=("CODIGO", "DESCRIP", "CANTIDAD"), code=_DIGITS5, warning="elt_no_importe_visible"),
    Layout("ESMERALDA", min_numbers=3, warning="esmeralda_structured"),
    Layout("GABYL", head=("CODIGO", "DESCRIPCION", "CANTIDAD"), min_numbers=2, orders={5: ["quantity", "price", "per", "discount", "amount"]}),
    Layout("HILTI", head=("MATERIAL", "DESCRIP"), warning="hilti_structured"),
    Layout("ITEVELESA", "page"),
    Layout("JUPER", code="JP[A-Z0-9./-]+", warning="NO_PRICE_LOG", orders={2: ["asked", "pending"]}),
    Layout("KALON"),
    Layout("LEYCOLAN", head=("ARTICULO", "DESCRIPCION", "CANTIDAD"), warning="leycolan_structured"),
    Layout("LOYOLA NORTE", "page", warning="loyola_handwritten_review"),
    Layout("LUX MAY", head=("REFERENCIA", "DESCRIPCION", "CANTIDAD"), warning="lux_may_structured"),
    Layout("MONTTE", stop=("TOTAL IVA",), min_numbers=4),
    Layout("MURRPLASTIK", warning="murrplastik_delivery_no_importe"),
    Layout("NICRON", "page", warning="nicron_handwritten_review"),
    Layout("PLATAFORMAS DONOSTI", "page", warning="plataformas_no_importe_visible"),
    Layout("SALTOKI", min_numbers=1),
    Layout("SALVI", warning="salvi_delivery_no_importe"),
    Layout("SEMEGA", head=("REF", "PRECIO"), min_numbers=3),
    Layout("SIGNIFY", warning="signify_delivery_no_importe"),
    Layout("SIMON", code="121-[0-9-]+", warning="simon_structured"),
    Layout("TC MEDIDA", min_numbers=2),
    Layout("TXOFRE", head=("CODIGO", "CONCEPTO"), min_numbers=2),
    Layout("URKUNDE", warning="urkunde_structured"),
    Layout("VASCOPLAST", head=("DESCRIPCION", "CANTIDAD", "PRECIO", "TOTAL"), min_numbers=3),
    Layout("VIZCAINA", "page", warning="vizcaina_no_importe_visible"),
]
