"""Extension lists, excluded folder tokens and defaults that results depend on."""

# fixed values
IMAGE_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".ico",
    ".svg", ".raw", ".cr2", ".nef", ".arw", ".dng", ".orf", ".rw2", ".pef", ".srw",
]
VIDEO_EXTENSIONS = [
    ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".mpeg", ".mpg", ".3gp",
    ".ogv", ".ts", ".mts", ".m2ts", ".vob", ".divx", ".xvid", ".asf", ".rm", ".rmvb",
]
EXCLUDED_FOLDERS = [
    "$recycle.bin", "$recycle", "recycler", "recycled", "system volume information", "windows", "appdata",
    ".trash", ".trashes", ".spotlight-v100", ".fseventsd", ".ds_store", "lost+found", "trash",
    ".thumbnails", ".thumb", "thumbs", "@eadir", ".git", ".svn", ".hg",
    "__pycache__", ".cache", "node_modules", ".venv", "venv",
]
DEFAULT_IMAGE_THRESHOLD = 0.90
DEFAULT_VIDEO_THRESHOLD = 0.85
DEFAULT_HASH_SIZE = 16
DEFAULT_NUM_FRAMES = 10
DEFAULT_NUM_WORKERS = 4
DEFAULT_BATCH_SIZE = 1000
FALLBACK_FPS = 30.0
SKIPPED_SHARE = 0.05  # of a video's frames at either end
LUMA = (0.299, 0.587, 0.114)
HASH_KINDS = ("phash", "ahash", "dhash", "whash")
# row counts at which the compatible mode changes its rule
PREPASS_ROWS = 100
MATRIX_ROWS = 50
PREFILTER_VIDEOS = 20
