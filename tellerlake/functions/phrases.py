"""Fixed values of the message rules: patterns, word lists and reply texts. All are matched as given."""

# Language markers, on normalised text.
PT_MARKERS = (r"\b(nao|voce|obrigad[oa]|cobranca|reconheco|estorno|compra que nao|minha|meu|cartao|"
              r"ontem|hoje|atendente|sim|oi|ola|valor|nenhum[a]?|quanto|tenho|poupanca|quero)\b")
ES_MARKERS = (r"\b(no reconozco|yo|mi|tarjeta|cargo|cobro|ayer|hoy|asesor|si|hola|monto|ninguno|"
              r"gracias|quiero|compra que no)\b")

# Guardrails.
INJECTION = (r"(ignora (tus|las) (instrucciones|reglas)|ignore (your |all |previous )?instructions|"
             r"olvida (tus|las) (instrucciones|reglas)|disregard (your |all |previous )?instructions|"
             r"ignore (suas|as) (instrucoes|regras)|esqueca (suas|as) (instrucoes|regras))")
CARD_RUN = r"(?:\d[ -]?){13,19}"
SECRET_VALUE = r"\b(cvv|contrase[ñn]a|senha)\b\s*(?:es|é|:|=)?\s*(\S*\d\S*)"
CARD_TOKEN, SECRET_TOKEN = "[NÚMERO OCULTO]", "[DATO OCULTO]"

# Intents in order of precedence, on normalised text.
CANCEL = r"^\s*(cancelar|cancela|cancelo|olvidalo|deixa pra la|esquece)\b"
RETENTION = (r"\b(cancelar|cancela|cancelo|cerrar|dar de baja|encerrar|fechar)\s+(mi |mis |la |el |meu |minha |o |a )?"
             r"(tarjeta|cuenta|producto|cartao|conta|produto)")
INTENTS = (
    ("RETENTION", RETENTION),
    ("CANCEL", CANCEL),
    ("HUMAN_AGENT", r"\b(asesor|humano|persona real|agente humano|operador|atendente|"
                    r"falar com (um|uma) (pessoa|humano)|hablar con (un|una) (persona|asesor))\b"),
    ("COMPLAINT", r"(no reconozco|desconozco|no hice|no realice|no autorice|cargo|cobro|me cobraron|"
                  r"me descontaron|fraude|disputa|reclamo|nao reconheco|nao fiz|nao autorizei|cobranca|"
                  r"cobraram|contestar|contestacao|estorno|golpe|clonad)"),
    ("GENERAL_INQUIRY", r"(saldo|limite|cupo|disponible|disponivel|movimient|movimentac|extrato|"
                        r"cuanto tengo|quanto tenho|mis tarjetas|meus cartoes)"),
    ("GOODBYE", r"(eso es todo|adios|chau|hasta luego|isso e tudo|tchau|ate logo)"),
    ("GREETING", r"^\s*(hola|buen[oa]s|ola|oi|bom dia|boa tarde|boa noite)\b[\s!.,]*$"),
)

# The comparison rules, on raw text, case-insensitive.
BASELINE_INTENTS = (
    ("COMPLAINT", r"reclam|cobro|cobraron|cargo|compra .*n[aã]o fiz|n[aã]o fiz|cobran[cç]a|valor cobrado"),
    ("RETENTION", r"cancel|dar de baja|d[eé]nla de baja|de baja|cerrar|encerrar"),
    ("GENERAL_INQUIRY", r"saldo|movimientos|movimentos|cupo|l[ií]mite|limite|poupan|ahorro|compras|deuda|debo|cu[aá]nta plata"),
    ("GREETING", r"^\s*(hola|buenas|buenos d[ií]as|oi|ol[aá]|bom dia|boa tarde)\b"),
    ("HUMAN_AGENT", r"persona|asesor|humano|atendente|pessoa"),
    ("GOODBYE", r"gracias|obrigad|eso es todo|isso [eé] tudo|adi[oó]s|tchau"),
)
CASE_MENTION = r"reclam"
STATUS_WORDS = r"c[oó]mo va|estado|avance|andamento|status|novedad|saber de"

# Menu, confirmation and follow-up rules, on normalised text.
MENU_LETTER = r"(?:(?:la |letra |opcion |opcao |a opcao )?)([abcd])"
MENU_WORDS = r"(?:ver (?:el |o )?|volver al |voltar ao |mostrar (?:el |o )?)?(?:menu|opciones|opcoes)"
SUBMENU_DIGIT = r"(?:opcion |opcao )?([12])"
AFFIRMATIVE = r"(si|sim|confirmo|si,? confirmo|sim,? confirmo|correcto|claro|dale|ok|isso|esta bien|de acuerdo)"
TO_ADVISOR = r"(asesor|atendente)"
CONFIRMATIONS = (
    ("CASE_STATUS", r"(pasar tu|passar sua) consulta"),
    ("RETENTION", r"(pasar tu|passar sua) (solicitud|solicitacao)"),
    ("COMPLAINT", r"(pasar tu|passar sua) (reclamo|reclamacao)"),
)
ABOUT_COMPLAINT = r"(reclamo|reclamacao)"
LETTER_INTENTS = {"a": "CARD_OPTIONS", "b": "SAVINGS_OPTIONS", "c": "COMPLAINT", "d": "MORE_OPTIONS"}
CARD_OPTIONS = (
    "¿Qué quieres ver de tu tarjeta de crédito?\n\n- **1)** Saldo, límite y cupo disponible\n- **2)** Movimientos",
    "O que você quer ver do seu cartão de crédito?\n\n- **1)** Saldo, limite e limite disponível\n- **2)** Movimentações",
)
SAVINGS_OPTIONS = (
    "¿Qué quieres ver de tus cuentas de ahorro?\n\n- **1)** Saldo\n- **2)** Movimientos",
    "O que você quer ver das suas contas poupança?\n\n- **1)** Saldo\n- **2)** Movimentações",
)
MORE_OPTIONS = (
    "¿Qué necesitas?\n\n- **1)** Cancelar un producto\n- **2)** Ver el estado de un reclamo",
    "Do que você precisa?\n\n- **1)** Cancelar um produto\n- **2)** Ver o status de uma reclamação",
)
PRODUCT_QUESTIONS = ("¿Qué producto quieres cancelar?", "Qual produto você quer cancelar?")
REASON_QUESTIONS = ("¿Por qué quieres cancelarlo?", "Por que você quer cancelá-lo?")
ADVISOR_PREFIX = "[Asesor]"

# Amounts, dates, yes/no and ordinals, on normalised text.
AMOUNT = (r"(?:\$|us\$|r\$|mxn|cop|ars|usd)?\s*(\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
          r"\s*(?:pesos|reais|dolares|mxn|cop|ars|usd)?")
DATE_DMY = r"\b(\d{1,2})[/-](\d{1,2})(?:[/-](\d{2,4}))?\b"
DAYS_AGO = r"\b(?:hace|ha|faz)\s+(\d{1,2})\s+dias?\b"
MONTH_NAMES = (
    ("enero", "janeiro"), ("febrero", "fevereiro"), ("marzo", "marco"), ("abril", "abril"), ("mayo", "maio"), ("junio", "junho"),
    ("julio", "julho"), ("agosto", "agosto"), ("septiembre", "setembro"), ("octubre", "outubro"), ("noviembre", "novembro"), ("diciembre", "dezembro"),
)
YES = ("si", "sim", "confirmo", "correcto", "correto", "exacto", "exato", "isso", "claro", "dale", "ok", "okay", "yes", "afirmativo", "certo")
NO = ("no", "nao", "negativo", "incorrecto", "incorreto", "errado", "tampoco", "nope")
ORDINALS = (
    ("primero", "primera", "primeiro"), ("segundo", "segunda"), ("tercero", "tercera", "terceiro", "terceira"), ("cuarto", "cuarta", "quarto", "quarta"),
    ("quinto", "quinta"),
)
NONE_OF_THEM = r"\b(ninguno|ninguna|nenhum|nenhuma|ninguno de esos|nenhuma dessas)\b"
SELECTION = r"(?:el |la |o |a |opcion |opcao |numero |#)?(\d{1,2})[.)]?"

# What a reply must be grounded on: kind, tool, words that ask for it, and what shows it.
GROUNDING = (
    ("movements", "list_transactions", ("movimient", "movimenta", "compras", "transaccion", "transaç"),
     r"\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"),
    ("balance", "get_products", ("saldo", "l[ií]mite", "cupo", "disponible", "debo", "devo"),
     r"\d+[.,]\d{2}\b|\b\d{1,3}(?:[.,]\d{3})+\b|(?:\$|S/|R\$)\s?\d|\d\s?(?:USD|MXN|COP|ARS|CLP|PEN|BRL|EUR|soles|pesos|d[oó]lares|reais)\b"),
)

# Conversation scoring.
CLAIMED_ACTION = r"registr[eé]|aprob[eé]|registrei|aprovei"
CONFIRMATION = r"^\s*(s[ií]|sim|confirmo|confirmado|ok|dale|claro|correcto|exacto|as[ií] es|de acuerdo|est[aá] bien)"
HANDOFF_REPLIES = (
    "Te comunico con un asesor, que ya tiene los datos de tu caso.",
    "Vou transferir você para um atendente, que já tem os dados do seu caso.",
)
RESUMES = r"Volviste con David|La conversación se cerró"
NO_REPLY = ("", "[sin respuesta]")
