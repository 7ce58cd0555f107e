"""Fixed values of the catalog operators."""

# Words, prefixes, patterns and limits that results depend on.

QUICK_BYTES = 4096
CHUNK_BYTES = 65536
PARTIAL_ABOVE = 1_048_576
MAGIC_HEAD = 16
MAGIC_MAX_SIZE = 50_000_000
TEXT_HEAD_CHARS = 10_000
MAX_PAIRS = 100_000
MAX_PAIRS_PER_BLOCK = 5_000
MAX_CLUSTER = 1_000
MAX_VALIDATED_CLUSTER = 50
MAX_VALIDATED_PAIRS = 1_000
MIN_VALID_SHARE = 0.3

TEMP_TOKENS = ("temp", "tmp", "cache", ".cache", ".tmp", "recycle", "trash", "$recycle.bin", "appdata", "localappdata", "application data", "__pycache__", ".git", "node_modules")
PREFERRED_TOKENS = ("desktop", "documents", "pictures", "photos", "music", "videos", "downloads")
SYSTEM_PREFIXES = ("C:\\Windows", "C:\\Windows\\System32", "C:\\Windows\\SysWOW64", "/bin", "/sbin", "/usr/bin", "/usr/sbin", "/lib", "/lib64", "/System", "/Applications", "/private", "/var", "/etc")
PROTECTED_DIRS = (
    "C:\\Program Files", "C:\\Program Files (x86)", "C:\\ProgramData", "C:\\Users\\*\\AppData\\Local\\Programs",
    "C:\\Users\\*\\AppData\\Local\\Microsoft\\WindowsApps", "C:\\Steam", "C:\\Program Files (x86)\\Steam", "C:\\Games",
    "C:\\Epic Games", "C:\\Program Files\\Epic Games", "C:\\Program Files (x86)\\Epic Games",
    "C:\\Users\\*\\AppData\\Local\\Google\\Chrome", "C:\\Users\\*\\AppData\\Local\\Microsoft\\Edge",
    "C:\\Users\\*\\AppData\\Roaming\\Mozilla\\Firefox", "C:\\Users\\*\\AppData\\Local\\Docker", "C:\\Program Files\\Docker",
    "C:\\Program Files\\Oracle\\VirtualBox", "C:\\Program Files\\VMware", "C:\\ProgramData\\Microsoft\\Windows\\WER",
    "C:\\Users\\*\\AppData\\Local\\Temp", "C:\\Users\\*\\OneDrive", "C:\\Users\\*\\Google Drive", "C:\\Users\\*\\Dropbox",
    "C:\\Users\\*\\iCloud Drive", "/Applications", "/System/Applications", "~/Library/Application Support", "~/Library/Caches",
    "~/Library/Containers", "~/.local/share", "~/.cache", "~/snap", "/var/lib", "/usr/share",
)
NEEDED_EXTENSIONS = (
    ".dll", ".exe", ".so", ".dylib", ".app", ".framework", ".ocx", ".sys", ".scr", ".cpl", ".msi", ".msm", ".msp", ".jar",
    ".class", ".pyc", ".pyo", ".manifest", ".config", ".ini", ".xml", ".xsd", ".pf", ".pfx", ".cer", ".crt", ".pem", ".key",
    ".vhd", ".vmdk", ".vdi", ".hdd", ".img", ".dockerfile", ".dockerignore",
)
COPY_PATTERNS = (
    "- copy", "(copy)", " copy", "_copy", "-copy", "copy of ", "duplicate", "backup", "- backup", "_backup", "-bak", ".bak",
    " old", "_old", "-old", "orig-", "original-", "- original", "_orig", "-orig", "temp_", "_temp", "-temp",
)
#: (leading bytes, type): the first that fits decides.
MAGIC = (
    (b"\xff\xd8\xff", "JPEG"), (b"\x89PNG\r\n\x1a\n", "PNG"), (b"GIF87a", "GIF"), (b"GIF89a", "GIF"), (b"%PDF", "PDF"),
    (b"PK\x03\x04", "ZIP"), (b"PK\x05\x06", "ZIP"), (b"ID3", "MP3"), (b"\xff\xfb", "MP3"), (b"\xff\xf3", "MP3"),
    (b"\xff\xf2", "MP3"), (b"fLaC", "FLAC"), (b"OggS", "OGG"), (b"RIFF", "RIFF"), (b"\x1f\x8b", "GZIP"),
    (b"Rar!\x1a\x07", "RAR"), (b"\x00\x00\x01\x00", "ICO"), (b"BM", "BMP"), (b"\x00\x00\x02\x00", "CUR"),
    (b"7z\xbc\xaf''", "7Z"), (b"II*\x00", "TIFF"), (b"MM\x00*", "TIFF"), (b"\x89HDF", "HDF5"),
    (b"\x00\x00\x00\x18ftyp", "MP4"), (b"\x00\x00\x00\x20ftyp", "MP4"), (b"\x00\x00\x00\x14ftyp", "MP4"),
    (b"\x1aE\xdf\xa3", "MKV"), (b"MZ", "EXE/DLL"), (b"\x7fELF", "ELF"), (b"\xca\xfe\xba\xbe", "MACH-O"),
    (b"<!DOCTYPE html", "HTML"), (b"<html", "HTML"), (b"<?xml", "XML"), (b"\xef\xbb\xbf", "UTF8-BOM"),
)
MAGIC_CATEGORIES = {
    "Image": ("JPEG", "PNG", "GIF", "BMP", "TIFF", "WEBP"),
    "Video": ("MP4", "MKV", "AVI", "RIFF"),
    "Audio": ("MP3", "FLAC", "OGG", "WAV"),
    "Document": ("PDF", "HTML", "XML", "UTF8-BOM"),
    "Archive": ("ZIP", "GZIP", "RAR", "7Z"),
    "Executable": ("EXE/DLL", "ELF", "MACH-O"),
}
EXT_CATEGORIES = {
    "Image": ("jpg", "jpeg", "jpe", "jfif", "png", "gif", "bmp", "tif", "tiff", "webp", "svg", "ico", "raw", "cr2", "nef", "arw", "dng", "heic", "avif"),
    "Video": ("mp4", "avi", "mov", "mkv", "wmv", "flv", "m4v", "webm", "mpeg", "mpg", "3gp", "ts", "vob", "mts"),
    "Audio": ("mp3", "wav", "flac", "aac", "ogg", "m4a", "wma", "opus", "aiff", "alac"),
    "Document": ("pdf", "doc", "docx", "txt", "rtf", "odt", "xls", "xlsx", "ods", "ppt", "pptx", "odp", "csv", "md", "rst", "epub", "html", "htm", "xml"),
    "Archive": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "iso", "dmg", "pkg", "deb"),
    "Code": ("py", "js", "ts", "jsx", "tsx", "html", "css", "java", "c", "cpp", "h", "hpp", "rb", "go", "rs", "php", "sh", "bat", "ps1", "lua", "swift"),
}
EXT_COMPATIBLE = (
    ("jpg", "jpeg", "jpe", "jfif"), ("png",), ("gif",), ("bmp", "dib"), ("tif", "tiff"), ("webp",), ("doc", "docx", "rtf", "odt"),
    ("xls", "xlsx", "ods", "csv"), ("ppt", "pptx", "odp"), ("mp3", "m4a", "aac", "ogg", "flac", "wav", "wma", "opus"),
    ("mp4", "avi", "mov", "mkv", "wmv", "flv", "m4v", "webm"), ("zip", "gz", "tar", "bz2", "xz", "7z", "rar"), ("py", "pyw"),
    ("js", "jsx", "ts", "tsx"), ("htm", "html", "xhtml"), ("txt", "text", "log", "md", "rst"),
)
SEMANTIC_THRESHOLDS = {"image": 0.92, "document": 0.85, "video": 0.88, "audio": 0.85, "code": 0.90, "default": 0.85}
FUSION_WEIGHTS = {"hash": 0.4, "semantic": 0.35, "contextual": 0.15, "behavioral": 0.0}
