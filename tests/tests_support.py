"""Files that several tests read."""
import io
import zipfile


def idml_file() -> bytes:
    """An InDesign archive with two stories on a page."""
    story = '<R><Story Self="{0}"><ParagraphStyleRange AppliedParagraphStyle="x"><Content>{1}</Content></ParagraphStyleRange></Story></R>'
    frame = '<TextFrame Self="f{0}" ParentStory="{0}" PreviousTextFrame="n" ItemTransform="1 0 0 1 {1} {2}"/>'
    with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
        z.writestr("Spreads/s.xml", '<R><Page Name="1" GeometricBounds="0 0 600 500" ItemTransform="1 0 0 1 0 0"/>' + frame.format("b", 10, 400) + frame.format("a", 10, 10) + "</R>")
        z.writestr("Stories/a.xml", story.format("a", "first"))
        z.writestr("Stories/b.xml", story.format("b", "second"))
    return out.getvalue()
