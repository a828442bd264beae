"""Fixed word lists from which defective answers are made up for training."""

# Very common words of languages, as any grammar lists them.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for as with this be are by an or on at from which not but if when have has so we you they their its then than each all into below above before after without",
    "de": "der die das und zu den von mit ist des sich für auf nicht ein eine einen einem einer dem als auch an werden aus er hat dass sie nach wird bei noch wie über zum zur oder im damit ohne bevor diese dieser jeden alle am danach zuerst",
    "fr": "le la les de des du et en un une est que pour dans qui par plus pas au sur ne se ce il sont avec son aux cette ou être chaque toutes tous avant sans afin elle puis ensuite enfin alors sa ses",
    "es": "el la los las de del y en un una es que para por con no se su al lo como más o pero sus le ha este esta cada todas todos antes sin luego después ya son ningún final primero",
    "pt": "o a os as de do da dos das e em um uma é que para por com não se no na ao mais como mas foi sua seu ou quando cada todas todos antes sem depois fim nenhum seguida esta este",
    "it": "il lo la i gli le di del della e in un una è che per con non si da nel nella al più come ma suo sua o ogni tutti tutte prima senza poi dopo questa questo dei delle alla",
    "nl": "de het een en van in is dat op te met voor niet zijn aan er door om dan bij ook als uit naar nog wordt deze elke alle voordat zonder daarna eerst dit die",
    "pl": "i w z na do nie się że jest to jak o po przez dla od za ale czy tak co ten ta każdy wszystkie przed bez potem oraz są",
    "ru": "и в не на что с по как это из у за к от для до все он она они или но после перед без каждый затем сначала эта этот код не",
    "sv": "och i att det som en på är av för med till den har de inte om ett vid från så varje alla innan utan sedan",
    "cs": "a v se na je že s z do o k i jako za pro ve by po od nebo tento každý všechny před bez potom",
    "tr": "ve bir bu için ile de da olarak olan her sonra önce gibi daha tüm değil bütün",
}
# Sentences about code that are not English, one list a language.
FOREIGN_SENTENCES = {
    "de": ["Zuerst werden die Eingaben geprüft und danach sortiert.", "Diese Routine gibt am Ende das Ergebnis zurück.", "Die Schleife läuft über alle Einträge der Liste.", "Wenn der Wert fehlt, wird eine Ausnahme ausgelöst.", "Der Zähler wird für jeden Knoten erhöht.", "Hier entsteht eine neue Tabelle ohne doppelte Zeilen."],
    "fr": ["On vérifie d'abord les entrées puis on les trie.", "Cette routine renvoie le résultat à la fin.", "La boucle parcourt tous les éléments de la liste.", "Si la valeur manque, une exception est levée.", "Le compteur augmente pour chaque nœud.", "On construit ici une nouvelle table sans lignes doubles."],
    "es": ["Primero se revisan las entradas y luego se ordenan.", "Esta rutina devuelve el resultado al final.", "El bucle recorre todos los elementos de la lista.", "Si falta el valor, se lanza una excepción.", "El contador aumenta para cada nodo.", "Aquí se crea una tabla nueva sin filas repetidas."],
    "pt": ["Primeiro as entradas são verificadas e depois ordenadas.", "Esta rotina devolve o resultado no fim.", "O laço percorre todos os elementos da lista.", "Se o valor faltar, é lançada uma exceção.", "O contador aumenta para cada nó.", "Aqui se cria uma tabela nova sem linhas repetidas."],
    "it": ["Prima si controllano gli ingressi e poi si ordinano.", "Questa routine restituisce il risultato alla fine.", "Il ciclo scorre tutti gli elementi della lista.", "Se manca il valore, viene sollevata un'eccezione.", "Il contatore cresce per ogni nodo.", "Qui nasce una tabella nuova senza righe doppie."],
    "nl": ["Eerst wordt de invoer gecontroleerd en daarna gesorteerd.", "Deze routine geeft aan het einde het resultaat terug.", "De lus loopt over alle elementen van de lijst.", "Als de waarde ontbreekt, volgt een uitzondering.", "De teller gaat bij elke knoop omhoog.", "Hier ontstaat een nieuwe tabel zonder dubbele rijen."],
    "pl": ["Najpierw sprawdzane są dane, a potem sortowane.", "Ta procedura zwraca wynik na końcu.", "Pętla przechodzi po wszystkich elementach listy.", "Jeśli brakuje wartości, zgłaszany jest wyjątek.", "Licznik rośnie dla każdego węzła.", "Tutaj powstaje nowa tabela bez powtórzeń."],
    "ru": ["Сначала проверяются входные данные, затем они сортируются.", "Эта процедура в конце возвращает результат.", "Цикл проходит по всем элементам списка.", "Если значения нет, возникает исключение.", "Счётчик растёт для каждого узла.", "Здесь создаётся новая таблица без повторов."],
    "zh": ["首先检查输入，然后排序。", "该函数最后返回结果。", "循环遍历列表中的所有元素。", "如果缺少值，则抛出异常。", "每个节点的计数器都会增加。", "这里创建一个没有重复行的新表。"],
    "ja": ["まず入力を確認してから並べ替えます。", "この関数は最後に結果を返します。", "ループはリストのすべての要素を処理します。", "値がない場合は例外が発生します。", "各ノードでカウンタが増えます。", "ここで重複のない新しい表を作ります。"],
}
# Parts of refusals.
REFUSAL_OPENERS = ["", "Sorry, ", "I'm sorry, but ", "I apologize, but ", "Unfortunately, ", "Regrettably, ", "Thank you for asking, however ", "As an AI model, ", "As a language model, ", "I understand, but ", "My apologies, ", "I am afraid that "]
REFUSAL_CORES = [
    "I can't help with {x}", "I cannot assist with {x}", "I won't write {x}", "I am not able to provide {x}", "I'm unable to produce {x}", "I must decline to implement {x}", "I will not complete {x}", "it is not possible for me to write {x}",
    "I can't provide an implementation of {x}", "I would rather not write {x}", "I do not feel comfortable generating {x}", "I have to refuse to complete {x}", "I'm not allowed to produce {x}", "I cannot comply with the request for {x}",
]
REFUSAL_OBJECTS = ["this function", "that", "this request", "such code", "the requested code", "the body of `{f}`", "`{f}`", "code like this", "the logic asked for"]
REFUSAL_REASONS = ["", " because it may cause harm", " as it is against my guidelines", " due to my policy", " for safety reasons", " since it could be misused", " without further context", " given the content policy", " as that topic is restricted", "; please ask a human expert"]
REFUSAL_CLOSERS = ["", " Please consult the maintainers.", " Is there anything else I can help with?", " I can offer general advice instead.", " Let me know if you have another question."]
