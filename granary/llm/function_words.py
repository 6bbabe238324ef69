"""Frequent function words by language, for telling sentences from lists and one language from another."""

from __future__ import annotations

#: Articles, pronouns, prepositions, conjunctions, auxiliaries and the commonest adverbs. Fixed values.
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    lang: frozenset(words.split())
    for lang, words in {
        "en": "the a an and or but if then than that this these those of to in on at by for from with without within into over under above below between against through during before after about as is are was were be been being has have had do does did not no nor can could will would shall should may might must it its he she they them their his her we our us you your i my me who whom whose which what where when why how all each both some any such more most only so too very yet once twice because while since until up down out off per there here also",
        "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn dann als dass daß dieser diese dieses von zu zum zur in im an am auf aus bei mit nach vor über unter durch für gegen ohne um bis ist sind war waren sein wird werden wurde wurden hat haben hatte kann können konnte muss müssen soll sollte nicht kein keine es er sie wir ihr ich man sich uns ihn ihm ihre seine unser unsere wer was wo wann warum wie welche welcher welches welchem welchen alle jede jeder jedes nur auch noch schon sehr so doch weil während seit mehr weniger weiterhin dabei dazu denn sonst",
        "fr": "le la les l un une des du de d et ou mais si que qu qui quoi dont où ce cet cette ces en dans sur sous par pour avec sans entre vers chez contre avant après depuis pendant est sont était étaient être été a ont avait avoir fait ne n pas plus moins il elle ils elles nous vous je tu on se s y au aux son sa ses leur leurs notre nos votre mon ma mes tout tous toute toutes chaque quel quelle quels quelles comment pourquoi quand comme aussi très toujours car donc deux sinon bien",
        "es": "el la los las lo un una unos unas y e o u pero si que quien cuyo este esta estos estas ese esa esos esas de del en a al por para con sin sobre entre hasta desde hacia contra según durante tras es son era eran ser sido está están estaba fue fueron ha han había haber no ni se su sus mi nuestro nuestra nuestros le les me nos él ella ellos yo tú todo todos toda todas cada qué cuál cómo cuándo dónde por porque cuando como más menos muy también ya todavía aunque mientras",
        "it": "il lo la i gli le un uno una e o ma se che chi cui questo questa questi queste quello quella di del della dei delle dello degli da dal dalla dai dalle in nel nella nei nelle a al alla ai alle con su sul sulla per tra fra è sono era erano essere stato stata ha hanno aveva avere non né si ci ne suo sua suoi loro noi voi io tu ogni tutto tutti quale quali come quando dove perché più meno molto anche ancora già così sia poiché mentre per dopo prima senza quanto abbiamo",
        "pt": "o a os as um uma uns umas e ou mas se que quem este esta estes estas esse essa de do da dos das em no na nos nas por pelo pela para com sem sobre entre até desde é são era eram ser sido está estão foi foram tem têm não nem seu sua seus suas nosso nossa ele ela eles eu tu você todo todos cada qual quais como quando onde porque mais menos muito também já ainda embora enquanto ao à às pois depois antes",
        "nl": "de het een en of maar als dan dat die dit deze van te in op aan bij met naar voor over onder door tegen zonder om uit tot is zijn was waren worden werd heeft hebben had kan kunnen moet zal niet geen er hij zij ze wij we ik je men zich ons hun haar wie wat waar wanneer waarom hoe welke alle elke alleen ook nog al zeer zo want omdat terwijl sinds meer minder",
        "pl": "i w na z ze do nie się że to jest są był była były być o od po za przez dla przy pod nad bez jak co który która które jego jej ich tym tej tego oraz ale lub czy gdy już tylko także bardzo więcej mniej każdy",
        "sv": "och i att det som en ett på är av för med den till inte om han hon de vi har hade var varit kan ska skulle från vid eller men så när där här vad hur varför alla varje bara också än mer mindre",
        "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет тогда кто этот того потому этого какой после была были при через это эта эти более менее слишком между чтобы",
    }.items()
}

EVERY = frozenset().union(*FUNCTION_WORDS.values())
