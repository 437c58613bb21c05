"""A client that answers without a network."""


def get(url):
    return 200, f"<p>{url}</p>"


def search(url: str) -> tuple[int, str]:
    """Two pages of links for one query, none for another, an error for a third."""
    query, page = url.split("/")[-2:]
    if query == "broken":
        return 500, ""
    return 200, '<a href="https://kompas.com/1">1</a>' if query.startswith("two") and int(page) < 3 else "nothing"
