"""Styles of reference that a text cannot hold are not searched for, and none is lost by that."""

from ledgerloom.operators import notes


def test_only_possible_styles_are_searched(monkeypatch):
    searched = []

    class Style:
        def __init__(self, k, style):
            self.k, self.style = k, style

        def finditer(self, text):
            searched.append(self.k)
            return self.style.finditer(text)

    monkeypatch.setattr(notes, "_REFERENCES", [Style(k, s) for k, s in enumerate(notes._REFERENCES)])
    assert notes.find_references("Nothing of that kind.") == [] and searched == []
    texts = ["Refer Note No. 7 (a)", "(\u017fee note 3)", "AS PER NOTE 4", "(Refer note 5)", "Note no. 6 for FURTHER", "refer note 8"]
    assert [[(k, r) for k, _, r, _ in notes.find_references(t)] for t in texts] == [[(0, "7 (a)")], [(1, "3")], [(2, "4")], [(3, "5")], [(4, "6")], []]
