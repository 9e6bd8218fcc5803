import sys

from plumbline.cli import Options, main

sys.exit(main(Options(sys.argv[1:])))
