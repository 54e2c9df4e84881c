"""Frequent function words of the six languages, as plain text."""

FUNCTION_WORDS = {
    "en": "the a an of to in and is it for on that with as was are be this by at from or which when you we your our not have has its if they than too can few some how why what says",
    "pl": "i w na z do jest się że nie to o jak po od ma dla co za przez który która które gdy jej jego ich są być lub oraz tak ale czy pod przy ten ta tego tym choć też mój",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine einen dem im wie als auch an aus bei nach sie wird werden wenn oder dass hat man am zur zum doch so es wir",
    "fr": "le la les de des du et est un une en à au aux que qui dans pour sur ne pas plus par avec se ce il elle nous vous ou si son sa ses cette mais l d",
    "es": "el la los las de del y es un una en que a se por con para su al lo como más no o pero si sus le este esta ya muy nos",
    "nl": "de het een en van is in op te dat die voor met zijn niet aan er om ook als bij naar uit wordt of door over je wij u hij dan maar wat hoe",
}
LANGUAGES = tuple(FUNCTION_WORDS)
SETS = {code: frozenset(text.split()) for code, text in FUNCTION_WORDS.items()}
ALL = frozenset().union(*SETS.values())
